"""Trees as nested JSON files, gzip or plain, one for each tree of a forest.

No process holds a tree. A node's line follows from its path: what opens it, and what closes after it; the lines of a tree are sorted by
path as they are written. A file is read piece by piece, with no more at once than a node for each level.
"""

from __future__ import annotations

import gzip
import io
import json
import platform
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from canopygrid import schema
from canopygrid.config import TrainingConfig

VERSION = "1"
_KEY = re.compile(r"^(\d+),(\d+),(\d+) \((\d+)\)$")
#: Nodes as they are in a file: thresholds are as precise as their text.
NODE = schema.TREE_NODE.replace("threshold float", "threshold double")
#: Characters that are read at once, and nodes that are handed on at once.
PIECE, BATCH = 1 << 16, 4096
_BLANK, _DECODER = re.compile(r"[ \t\n\r]*"), json.JSONDecoder()
#: Settings in a file by their keys there, where these aren't the name in camel case.
KEYS = {"thresholds": "thresholds", "device_ids": "deviceIds", "ignored_colors": "ignoredColors", "use_cielab": "useCIELab"}


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return KEYS.get(name) or head + "".join(x.capitalize() for x in rest)


def pair(value: list) -> tuple[int, int]:
    if len(value) != 2:
        raise ValueError(f"{value} has not two entries")
    return int(value[0]), int(value[1])


def feature_of(split: dict) -> dict:
    """A feature from a split; only colour has channels, any other type but depth fails."""
    f = split["feature"]
    if f["type"] not in ("color", "depth"):
        raise ValueError(f"unknown type of feature: {f['type']}")
    out = {"feature_id": split.get("featureId", 0), "type": f["type"], "ch1": f.get("channel1", 0) if f["type"] == "color" else 0, "ch2": f.get("channel2", 0) if f["type"] == "color" else 0}
    for k in "12":
        out[f"o{k}x"], out[f"o{k}y"] = pair(f[f"offset{k}"])
        out[f"r{k}x"], out[f"r{k}y"] = pair(f[f"region{k}"])
    return out


def node_text(colors: dict[int, str], more: list[Column] = ()) -> Column:
    """A node as JSON, without its children."""
    names = F.array(*[F.lit(colors.get(i, "0,0,0")) for i in range(max(colors, default=0) + 1)])
    entry = lambda n, i: F.struct(F.concat(F.coalesce(F.get(names, i), F.lit("0,0,0")), F.lit(" ("), i.cast("string"), F.lit(")")).alias("key"), n.alias("value"))
    hist = F.map_from_entries(F.filter(F.transform("histogram", entry), lambda e: e["value"] != 0))
    f = lambda c: F.col(f"feature.{c}")
    channels = [F.when(f("type") == "color", f(f"ch{k}")).alias(f"channel{k}") for k in "12"]
    places = [F.array(f(f"{c}{k}x"), f(f"{c}{k}y")).alias(f"{name}{k}") for k in "12" for c, name in (("o", "offset"), ("r", "region"))]
    split = F.struct(F.col("threshold").cast("double").alias("threshold"), F.col("score").cast("double").alias("score"), f("feature_id").alias("featureId"), F.struct(f("type").alias("type"), *channels, *places).alias("feature"))
    node = F.struct(F.col("node_id").alias("id"), "level", F.col("n_samples").alias("samples"), F.col("is_leaf").alias("leaf"), hist.alias("histogram"), *more, F.when(~F.col("is_leaf"), split).alias("split"))
    return F.to_json(node, {"ignoreNullFields": "true"})


def header_json(config: TrainingConfig, priors: list[int], colors: dict[int, str], date: str = "") -> dict:
    """What a file says before its tree."""
    head = {camel(k): list(v) if isinstance(v, tuple) else v for k, v in config.to_dict().items()}
    host = {"hostname": platform.node(), "buildType": "release", "version": VERSION, "date": date, "processorModels": [platform.processor() or platform.machine()]}
    return host | head | {"labelColors": {str(k): v for k, v in sorted(colors.items())}, "classLabelPriorDistribution": {str(i): n for i, n in enumerate(priors)}}


def node_paths(nodes: DataFrame) -> DataFrame:
    """``tree_id``, ``node_id``, ``path`` of every node below its tree's first: 0 for each step to the left, 1 to the right.

    A round joins each piece of a path with the piece above it, so pieces double: rounds grow with the logarithm of the depth.
    """
    from canopygrid.plans.forest import remove, shared_table

    tops = nodes.groupBy("tree_id").agg(F.min("node_id").alias("top"))
    child = lambda c, side: F.struct(F.col(c).alias("node_id"), F.lit(side).alias("path"))
    steps = nodes.where(~F.col("is_leaf")).select("tree_id", F.col("node_id").alias("up"), F.explode(F.array(child("left_id", "0"), child("right_id", "1"))).alias("c"))
    steps = shared_table(steps.select("tree_id", "c.node_id", "up", "c.path").join(F.broadcast(tops), "tree_id"), "paths")
    length, most = 1, nodes.count()
    while not (open_ := steps.where("up <> top")).isEmpty():
        if length > most:
            raise ValueError("the nodes of a tree go in circles")
        above = steps.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("over"), F.col("path").alias("before"))
        longer = open_.join(above, ["tree_id", "up"]).select("tree_id", "node_id", F.col("over").alias("up"), F.concat("before", "path").alias("path"), "top")
        done, steps = steps, shared_table(steps.where("up = top").unionByName(longer), "paths")
        remove(done)
        length *= 2
    return steps.select("tree_id", "node_id", "path").unionByName(tops.select("tree_id", F.col("top").alias("node_id"), F.lit("").alias("path")))


def write_forest(spark: SparkSession, folder: str, nodes: DataFrame | list[dict], config: TrainingConfig, priors: list[int], colors: dict[int, str], date: str = "") -> None:
    """``tree<n>`` folders of a gzip JSON file each, a line for each node, through Spark's writer, so to any store that it reaches.

    ``nodes`` are rows of ``tree_node``, of any number, and may have ``counts_per_image``, a map; a tree's first node has its least id.
    """
    from canopygrid.plans.forest import remove, shared_table

    names = StructType.fromDDL(NODE).names
    counted = ["counts_per_image"] if isinstance(nodes, DataFrame) and "counts_per_image" in nodes.columns else []
    if not isinstance(nodes, DataFrame):
        nodes = spark.createDataFrame([tuple(n[c] for c in names) for n in nodes], NODE)
    nodes = shared_table(nodes.select(*names, *counted), "nodes")
    path, leaf = F.col("path"), F.col("is_leaf")
    opening = F.when(path == "", json.dumps(header_json(config, priors, colors, date), sort_keys=True)[:-1] + ', "tree": ').when(path.endswith("0"), ', "left": ').otherwise(', "right": ')
    # A leaf ends the nodes whose right ends it is, and the file with the last one.
    closing = F.concat(F.repeat(F.lit("}"), F.length(F.regexp_extract("path", "1*$", 0))), F.when(path.rlike("^1*$"), "}").otherwise(""))
    body = node_text(colors, [F.col(c).alias("countsPerImage") for c in counted])
    text = F.concat(opening, F.when(leaf, F.concat(body, closing)).otherwise(F.expr("substring(body, 1, length(body) - 1)")))
    lines = shared_table(nodes.join(node_paths(nodes), ["tree_id", "node_id"]).withColumn("body", body).select("tree_id", "path", "is_leaf", text.alias("value")), "lines")
    trees = lines.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~leaf).alias("inner")).orderBy("tree_id").collect()
    if broken := [r.tree_id for r in trees if r.n != 2 * r.inner + 1]:
        raise ValueError(f"trees {broken} lack children of their nodes")
    for r in trees:
        lines.where(F.col("tree_id") == r.tree_id).coalesce(1).sortWithinPartitions("path").select("value").write.mode("overwrite").option("compression", "gzip").text(f"{folder}/tree{r.tree_id}.json")
    for done in (nodes, lines):
        remove(done)


class _Pieces:
    """A JSON text, gzip or plain, read piece by piece; no more than one value is held."""

    def __init__(self, data: bytes):
        raw = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))
        self.stream, self.text, self.at = io.TextIOWrapper(raw, json.detect_encoding(raw.peek(4)[:4])), "", 0

    def more(self) -> bool:
        piece = self.stream.read(PIECE)
        self.text, self.at = self.text[self.at :] + piece, 0
        return bool(piece)

    def next(self) -> str:
        """The next character that isn't blank; it is not taken."""
        while True:
            self.at = _BLANK.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                raise ValueError("a file ends within its tree")

    def take(self, c: str) -> None:
        if self.next() != c:
            raise ValueError(f"{c} was expected, not {self.text[self.at]}")
        self.at += 1

    def value(self):
        self.next()
        while True:
            start = self.at
            try:
                found, end = _DECODER.raw_decode(self.text, self.at)
            except json.JSONDecodeError:
                if not self.more():
                    raise
                continue
            # A number may go on in the next piece.
            if end < len(self.text):
                self.at = end
                return found
            if not self.more():
                self.at = end - start
                return found

    def keys(self) -> Iterator[str]:
        """The keys of an object; who asks for the next one has read the value."""
        self.take("{")
        while self.next() != "}":
            key = self.value()
            self.take(":")
            yield key
            if self.next() != ",":
                break
            self.at += 1
        self.take("}")


def walked(text: _Pieces) -> Iterator[tuple[dict, int | None]]:
    """Nodes of a nested tree without their children, whose ids they have in ``left`` and ``right``, and their parents' ids; children first."""
    stack: list[tuple] = [(text.keys(), {}, [], None)]
    while stack:
        keys, node, waiting, side = stack[-1]
        key = next(keys, None)
        if key in ("left", "right") and text.next() == "{":
            stack.append((text.keys(), {}, [], key))
        elif key is not None:
            node[key] = text.value()
        else:
            stack.pop()
            # Children whose parent's id came after them.
            yield from ((child, node["id"]) for child in waiting)
            if not stack:
                yield node, None
                continue
            _, parent, held, _ = stack[-1]
            parent[side] = node["id"]
            if "id" in parent:
                yield node, parent["id"]
            else:
                held.append(node)


def node_row(node: dict, tree_id: int, parent: int | None, classes: int, colors: dict[int, str]) -> dict:
    """A row of ``tree_node``, its children's ids left out; the colours of its labels go to ``colors``."""
    hist = [0] * classes
    seen = set()
    for key, n in node["histogram"].items():
        m = _KEY.match(key)
        if not m:
            raise ValueError(f"illegal key of a histogram: {key!r}")
        label = int(m[4])
        if label in seen or label >= classes:
            raise ValueError(f"label {label} of a histogram is there twice, or not a class")
        seen.add(label)
        hist[label] = int(n)
        colors[label] = f"{m[1]},{m[2]},{m[3]}"
    if sum(hist) < node["samples"]:
        raise ValueError(f"node {node['id']} has fewer counts than samples")
    row = {"tree_id": tree_id, "node_id": node["id"], "level": node["level"], "parent_id": parent, "left_id": None, "right_id": None, "is_leaf": bool(node["leaf"]), "n_samples": node["samples"], "histogram": hist, "feature": None, "threshold": None, "score": None}
    if not row["is_leaf"]:
        row |= {"feature": feature_of(node["split"]), "threshold": float(node["split"]["threshold"]), "score": float(node["split"]["score"])}
    return row


def flat_nodes(tree: dict, tree_id: int, classes: int) -> tuple[list[dict], dict[int, str]]:
    """Rows of ``tree_node`` and the colours of the labels; a class twice, or fewer counts than samples, fails."""
    rows, colors = [], {}

    def visit(node: dict, parent: int | None) -> int:
        row = node_row(node, tree_id, parent, classes, colors)
        rows.append(row)
        if not row["is_leaf"]:
            row["left_id"], row["right_id"] = (visit(node[k], node["id"]) for k in ("left", "right"))
        return node["id"]

    visit(tree, None)
    return sorted(rows, key=lambda r: r["node_id"]), colors


def priors_of(header: dict) -> list[int]:
    said = {int(k): int(v) for k, v in header["classLabelPriorDistribution"].items()}
    return [said.get(i, 0) for i in range(max(said) + 1)]


def file_rows(data: bytes, tree_id: int, classes: int | None = None) -> Iterator[dict]:
    """Rows of ``tree_node`` of a file, and last its ``header`` and the ``colors`` of its histograms."""
    text, header, colors, known = _Pieces(data), {}, {}, classes
    for key in text.keys():
        if key != "tree":
            header[key] = text.value()
            continue
        if known is None and "classLabelPriorDistribution" in header:
            known = len(priors_of(header))
        for node, parent in walked(text):
            if known is None:
                continue
            row = node_row(node, tree_id, parent, known, colors)
            below = {f"{k}_id": node.get(k) for k in ("left", "right")}
            if list(below.values()).count(None) != (2 if row["is_leaf"] else 0):
                raise ValueError(f"node {node['id']} is a leaf with children, or lacks one")
            yield row | below
    if known is None:
        # The classes come after the tree: it is read once more.
        yield from file_rows(data, tree_id, len(priors_of(header)))
        return
    yield {"header": header, "colors": colors}


def config_of(header: dict) -> TrainingConfig:
    """Settings of a file; missing keys get their defaults, but a file without a type of subsampling was pixel-uniform."""
    names = {camel(k): k for k in TrainingConfig().to_dict()}
    values = {names[k]: v for k, v in header.items() if k in names}
    if "deviceId" in header and "deviceIds" not in header:
        values["device_ids"] = header["deviceId"] if isinstance(header["deviceId"], list) else [header["deviceId"]]
    return TrainingConfig.from_dict({"subsampling_type": "pixelUniform"} | values)


def read_nodes(spark: SparkSession, folder: str) -> tuple[DataFrame, TrainingConfig, list[int], dict[int, str]]:
    """All trees below a folder: nodes, settings, priors, colours. Settings may only differ in what doesn't shape a tree, classes not at all.

    A task reads a file, compressed as it is, and what it hands on are rows; only headers come to the driver.
    """
    from canopygrid.plans.forest import shared_table

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("path").rlike(r"tree[0-9]+\.json"))
    order = sorted((r.path for r in files.select("path").collect()), key=lambda p: (int(re.search(r"tree(\d+)\.json", p)[1]), p))
    if not order:
        raise ValueError(f"no tree below {folder}")
    number = {p: t for t, p in enumerate(order)}
    columns = f"{NODE}, said string"
    kinds = to_arrow_schema(StructType.fromDDL(columns))

    def rows_of(path: str, data: bytes) -> Iterator[dict]:
        said = {"tree": number[path], "header": None, "colors": {}, "error": None}
        try:
            for row in file_rows(data, number[path]):
                if "header" in row:
                    said |= row
                else:
                    yield row
        except (ValueError, KeyError, EOFError, OSError) as e:
            said["error"] = f"{path}: {type(e).__name__} {e}"
        yield {"said": json.dumps(said)}

    def run(batches):
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                some = []
                for row in rows_of(path.as_py(), data.as_py()):
                    some.append(row)
                    if len(some) == BATCH:
                        yield pa.RecordBatch.from_pylist(some, kinds)
                        some = []
                yield pa.RecordBatch.from_pylist(some, kinds)

    rows = shared_table(files.select("path", "content").mapInArrow(run, columns), "nodes")
    config, priors, colors = None, None, {}
    for said in sorted((json.loads(r.said) for r in rows.where("said IS NOT NULL").select("said").collect()), key=lambda s: s["tree"]):
        if said["error"]:
            raise ValueError(said["error"])
        header, path = said["header"], order[said["tree"]]
        mine, dist = config_of(header), priors_of(header)
        if config is not None and (not config.equals(mine, strict=False) or len(dist) != len(priors)):
            raise ValueError(f"{path} is of another forest")
        config, priors = config or mine, priors or dist
        # Files of others name a label's colour only where a histogram has it.
        found = {int(k): v for k, v in (said["colors"] | header.get("labelColors", {})).items()}
        if any(colors.get(k, v) != v for k, v in found.items()):
            raise ValueError(f"{path} has other colours for its labels")
        colors |= found
    return rows.where("said IS NULL").drop("said"), config, priors, colors


def read_forest(spark: SparkSession, folder: str) -> tuple[list[dict], TrainingConfig, list[int], dict[int, str]]:
    """``read_nodes`` with the nodes as a list, for a forest that its settings bound."""
    nodes, *said = read_nodes(spark, folder)
    return [r.asDict(recursive=True) for r in nodes.orderBy("tree_id", "node_id").collect()], *said


def prior_rows(spark: SparkSession, priors: list[int]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(priors)), "label int, n long")
