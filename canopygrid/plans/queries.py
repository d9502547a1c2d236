"""Every operator as a query over the star tables, with SQL that must give the same rows.

Vectors stand in for images: 64 floats are a grid of 8 x 8, whole thousandths the first colour, and depth and labels follow from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.config import TrainingConfig
from canopygrid.functions import arrays, color, hashing, scoring, stats
from canopygrid.operators import features as feat
from canopygrid.operators import grid, inference, labels, metrics, sampling, splits
from canopygrid.plans import forest, tuning
from canopygrid.sources import images, model_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- the grids ---------------------------------------------------------------------------------------------------------------------


def pixels(spark: SparkSession, d: str) -> DataFrame:
    cells = grid.from_vectors(table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").alias("l")), "vec_id", "embedding")
    v = F.floor(F.col("v").cast("double") * 1000).cast("long")
    cells = cells.select("image_id", "x", "y", "l", v.alias("v"))
    return cells.select(
        "image_id", "x", "y", F.col("v").alias("c0"), (3 * F.col("v")).alias("c1"), (1000 - F.col("v")).alias("c2"), F.when(F.col("v") > -100, 1000 + F.col("v")).otherwise(0).cast("int").alias("depth"),
        (F.col("v") > -100).cast("int").alias("valid"), ((F.col("l") + F.floor(F.col("y") / 4)) % 4).cast("int").alias("label"),
    )


PIX = """pix AS (SELECT vec_id AS image_id, CAST(p % 8 AS INTEGER) AS x, CAST(p // 8 AS INTEGER) AS y, v AS c0, 3 * v AS c1, 1000 - v AS c2,
  CAST(CASE WHEN v > -100 THEN 1000 + v ELSE 0 END AS INTEGER) AS depth, CAST(v > -100 AS INTEGER) AS valid, CAST((l + p // 32) % 4 AS INTEGER) AS label
  FROM (SELECT vec_id, label AS l, p, CAST(floor(CAST(embedding[p + 1] AS DOUBLE) * 1000) AS BIGINT) AS v FROM embeddings, range(64) t(p)))"""
INT = f"""{PIX}, ir AS (SELECT *, sum(c0) OVER w AS a, sum(depth) OVER w AS b, sum(valid) OVER w AS c FROM pix WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
 ii AS (SELECT image_id, x, y, c0, depth, valid, CAST(sum(a) OVER w AS BIGINT) AS ic0, CAST(sum(b) OVER w AS BIGINT) AS idepth, CAST(sum(c) OVER w AS BIGINT) AS ivalid FROM ir WINDOW w AS (PARTITION BY image_id, x ORDER BY y))"""


@query("integral_image", f"WITH {INT} SELECT image_id, x, y, ic0, idepth, ivalid FROM ii")
def integral_image(spark, d):
    return grid.integral(pixels(spark, d), ["c0", "depth", "valid"]).select("image_id", "x", "y", "ic0", "idepth", "ivalid")


@query("integral_image_packed", f"WITH {INT} SELECT image_id, x, y, ic0, idepth, ivalid FROM ii")
def integral_image_packed(spark, d):
    packs = forest.image_packs(pixels(spark, d)).select("image_id", "width", F.posexplode(F.arrays_zip("ic0", "idepth", "ivalid")).alias("p", "z"))
    return packs.select("image_id", (F.col("p") % F.col("width")).alias("x"), F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), "z.ic0", "z.idepth", "z.ivalid")


@query("derivative_image", f"WITH {PIX} SELECT image_id, x, y, c0 AS dc0, CAST(depth AS BIGINT) AS ddepth FROM pix")
def derivative_image(spark, d):
    return grid.derivative(grid.integral(pixels(spark, d), ["c0", "depth"]), ["c0", "depth"]).select("image_id", "x", "y", "dc0", "ddepth")


@query("box_sum", f"WITH {PIX} SELECT image_id, CAST(sum(c0) AS BIGINT) AS box FROM pix WHERE x > 1 AND x <= 5 AND y > 2 AND y <= 4 GROUP BY image_id")
def box_sum(spark, d):
    at = lambda v: F.lit(v)
    return forest.image_packs(pixels(spark, d)).select("image_id", grid.box_sum("ic0", at(3), at(3), at(2), at(1)).cast("long").alias("box"))


@query("box_depth_mean", f"WITH {PIX} SELECT image_id, round(CASE WHEN sum(valid) > 0 THEN sum(depth) / 1000.0 / sum(valid) END, 9) AS mean_depth FROM pix WHERE x > 1 AND x <= 5 AND y > 2 AND y <= 4 GROUP BY image_id")
def box_depth_mean(spark, d):
    at = lambda v: F.lit(v)
    return forest.image_packs(pixels(spark, d)).select("image_id", F.round(grid.box_depth_mean(at(3), at(3), at(2), at(1)), 9).alias("mean_depth"))


FILL = f"""WITH {PIX}, f1 AS (SELECT *, coalesce(first_value(nullif(depth, 0) IGNORE NULLS) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS a FROM pix),
f2 AS (SELECT *, coalesce(last_value(nullif(a, 0) IGNORE NULLS) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS b FROM f1),
f3 AS (SELECT *, coalesce(last_value(nullif(b, 0) IGNORE NULLS) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS c FROM f2),
f4 AS (SELECT *, coalesce(first_value(nullif(c, 0) IGNORE NULLS) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS e FROM f3)
SELECT image_id, x, y, e AS depth, CAST(e > 0 AS INTEGER) AS valid FROM f4"""


@query("depth_fill", FILL)
def depth_fill(spark, d):
    return grid.depth_fill(pixels(spark, d)).select("image_id", "x", "y", "depth", "valid")


@query("pad_grid", f"WITH {PIX} SELECT i.image_id, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y, c0, coalesce(depth, 0) AS depth, coalesce(valid, 0) AS valid, coalesce(pix.label, 9) AS label FROM (SELECT DISTINCT vec_id AS image_id FROM embeddings) i CROSS JOIN range(10) a(gx) CROSS JOIN range(9) b(gy) LEFT JOIN pix ON pix.image_id = i.image_id AND x = gx AND y = gy")
def pad_grid(spark, d):
    return grid.padded(pixels(spark, d), 10, 9, 9).select("image_id", "x", "y", "c0", "depth", "valid", "label")


@query("pixel_depth", f"WITH {PIX} SELECT image_id, x, y, CASE WHEN valid = 1 THEN depth / 1000.0 END AS metres FROM pix")
def pixel_depth(spark, d):
    back = grid.derivative(grid.integral(pixels(spark, d), ["depth", "valid"]), ["depth", "valid"])
    return back.select("image_id", "x", "y", F.when(F.col("dvalid") == 1, F.col("ddepth") / 1000.0).alias("metres"))


@query("depth_normalize", f"WITH {PIX} SELECT image_id, x, y, CASE WHEN depth > 0 THEN CAST(trunc(CAST((x * 17 - 60) / CAST(CAST(depth / 1000.0 AS FLOAT) AS DOUBLE) AS FLOAT)) AS INTEGER) END AS near FROM pix")
def depth_normalize(spark, d):
    return pixels(spark, d).select("image_id", "x", "y", grid.normalized_offset(F.col("x") * 17 - 60, F.col("depth")).alias("near"))


@query("depth_view", f"WITH {PIX}, v AS (SELECT *, CASE WHEN valid = 1 THEN depth END AS dd FROM pix) SELECT image_id, x, y, round((dd - min(dd) OVER i) / nullif(CAST(max(dd) OVER i - min(dd) OVER i AS DOUBLE), 0), 9) AS scaled, CASE WHEN valid = 1 THEN round(cume_dist() OVER (PARTITION BY image_id, valid ORDER BY depth), 9) END AS equalized FROM v WINDOW i AS (PARTITION BY image_id)")
def depth_view(spark, d):
    return grid.depth_view(pixels(spark, d)).select("image_id", "x", "y", F.round("scaled", 9).alias("scaled"), F.round("equalized", 9).alias("equalized"))


@query("dump_plane", f"WITH {PIX} SELECT image_id, y, string_agg(CAST(c0 AS VARCHAR), ' ' ORDER BY x) AS line FROM pix GROUP BY image_id, y")
def dump_plane(spark, d):
    return grid.dumped(pixels(spark, d), "c0")


RGB = "SELECT p_partkey, CAST(p_partkey * 37 % 256 AS DOUBLE) AS r, CAST(p_size * 5 % 256 AS DOUBLE) AS g, CAST(floor(p_retailprice) AS BIGINT) % 256 AS b FROM part"


def rgb(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 37 % 256).cast("double").alias("r"), (F.col("p_size") * 5 % 256).cast("double").alias("g"), (F.floor("p_retailprice") % 256).cast("double").alias("b"))


def _lab_sql() -> str:
    lin = ", ".join(f"CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END AS l{c}" for c in "rgb")
    xyz = ", ".join(f"({' + '.join(f'CAST({m!r} AS DOUBLE) * l{c}' for m, c in zip(row, 'rgb'))}) / CAST({w!r} AS DOUBLE) AS t{k}" for k, (row, w) in enumerate(zip(color.TO_XYZ, color.WHITE)))
    f = ", ".join(f"CASE WHEN t{k} > 216.0 / 24389.0 THEN pow(t{k}, 1.0 / 3.0) ELSE (24389.0 / 27.0 * t{k} + 16) / 116 END AS f{k}" for k in range(3))
    return f"WITH a AS ({RGB}), l AS (SELECT p_partkey, {lin} FROM a), x AS (SELECT p_partkey, {xyz} FROM l), f AS (SELECT p_partkey, {f} FROM x) SELECT p_partkey, round(116 * f1 - 16, 6) AS lab_l, round(500 * (f0 - f1), 6) AS lab_a, round(200 * (f1 - f2), 6) AS lab_b FROM f"


@query("rgb_to_lab", _lab_sql())
def rgb_to_lab(spark, d):
    lab = color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return rgb(spark, d).select("p_partkey", *[(F.round(c, 6) + 0.0).alias(n) for c, n in zip(lab, ("lab_l", "lab_a", "lab_b"))])


@query("lab_round_trip", f"SELECT p_partkey, r AS red, g AS green, CAST(b AS DOUBLE) AS blue FROM ({RGB})")
def lab_round_trip(spark, d):
    lab = rgb(spark, d).select("p_partkey", *[c.alias(n) for c, n in zip(color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")), "lab")])
    return lab.select("p_partkey", *[F.abs(F.round(c, 2)).alias(n) for c, n in zip(color.lab_to_rgb(F.col("l"), F.col("a"), F.col("b")), ("red", "green", "blue"))])


# --- labels ------------------------------------------------------------------------------------------------------------------------

COL = "col AS (SELECT p_partkey, CAST(p_size * 5 % 256 AS INTEGER) AS r, CAST(p_partkey % 4 * 30 AS INTEGER) AS g, 0 AS b FROM part)"
DICT = f"""{COL}, seen AS (SELECT r, g, b, min(p_partkey) AS first_key FROM (SELECT * FROM col UNION ALL SELECT NULL, 0, 0, 0) GROUP BY r, g, b),
dict AS (SELECT CAST(row_number() OVER (ORDER BY CASE WHEN r = 0 AND g = 0 AND b = 0 THEN 0 ELSE 1 END, first_key) - 1 AS INTEGER) AS label, r, g, b FROM seen)"""


def colored(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") * 5 % 256).cast("int").alias("r"), (F.col("p_partkey") % 4 * 30).cast("int").alias("g"), F.lit(0).alias("b"))


def dictionary(spark, d):
    return labels.color_dictionary(colored(spark, d), ["p_partkey"], (0, 0, 0))


@query("color_dictionary", f"WITH {DICT} SELECT * FROM dict")
def color_dictionary(spark, d):
    return dictionary(spark, d)


@query("color_encode", f"WITH {DICT} SELECT p_partkey, label FROM col JOIN dict USING (r, g, b)")
def color_encode(spark, d):
    return labels.encoded(colored(spark, d), dictionary(spark, d)).select("p_partkey", "label")


@query("color_decode", f"WITH {COL} SELECT p_partkey, r, g, b FROM col")
def color_decode(spark, d):
    colors = dictionary(spark, d)
    return labels.decoded(labels.encoded(colored(spark, d), colors).select("p_partkey", "label"), colors).select("p_partkey", "r", "g", "b")


TEXTS = ("0,0000,00", "255,0255,255", "-1,0,0", "256,0,0", "a,0,0", "", ",,", "12,7,9")


@query("color_parse", f"SELECT p_partkey, CASE WHEN ok THEN CAST(s[1] AS INTEGER) END AS r, CASE WHEN ok THEN CAST(s[2] AS INTEGER) END AS g, CASE WHEN ok THEN CAST(s[3] AS INTEGER) END AS b FROM (SELECT p_partkey, string_split(t, ',') AS s, regexp_full_match(t, '0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(,0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])){{2}}') AS ok FROM (SELECT p_partkey, {list(TEXTS)}[1 + p_partkey % {len(TEXTS)}] AS t FROM part))")
def color_parse(spark, d):
    text = F.get(F.array(*map(F.lit, TEXTS)), (F.col("p_partkey") % len(TEXTS)).cast("int"))
    return table(spark, d, "part").select("p_partkey", labels.parsed_color(text).alias("c")).select("p_partkey", "c.r", "c.g", "c.b")


@query("label_color_map", f"WITH {DICT} SELECT DISTINCT label, concat_ws(',', r, g, b) AS color FROM col JOIN dict USING (r, g, b)")
def label_color_map(spark, d):
    colors = dictionary(spark, d)
    return labels.label_colors(labels.encoded(colored(spark, d), colors), colors)


CLASSES = {"ECONOMY": "prop", "STANDARD": "structure"}
CLASS_COLORS = {"prop": "1,2,3", "structure": "4,5,6", "furniture": "7,8,9"}


@query("class_mapping", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'prop' WHEN 'STANDARD' THEN 'structure' ELSE 'furniture' END AS class, CASE p_type WHEN 'ECONOMY' THEN '1,2,3' WHEN 'STANDARD' THEN '4,5,6' ELSE '7,8,9' END AS color FROM part")
def class_mapping(spark, d):
    part = table(spark, d, "part")
    named = part.select(F.col("p_type").alias("name")).distinct().withColumn("class", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv]), F.col("name")), F.lit("furniture")))
    colors = spark.createDataFrame(list(CLASS_COLORS.items()), "class string, color string")
    return labels.mapped_classes(part.select("p_partkey", F.col("p_type").alias("name")), named, colors).select("p_partkey", "class", "color")


@query("ignore_labels", f"WITH {PIX} SELECT label, count(*) AS n FROM pix WHERE label NOT IN (1, 3) GROUP BY label")
def ignore_labels(spark, d):
    return labels.without_labels(pixels(spark, d), [1, 3]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# --- sampling ----------------------------------------------------------------------------------------------------------------------


def _md5(*key) -> str:
    return "md5(concat_ws('-', " + ", ".join(f"'{k[1:]}'" if isinstance(k, str) and k[0] == "'" else str(k) for k in key) + "))"


def _draw(low: int, high: int, *key) -> str:
    return f"(CAST('0x' || substr({_md5(*key)}, 1, 8) AS BIGINT) % {high - low + 1} + {low})"


def _unit(*key) -> str:
    return f"(CAST('0x' || substr({_md5(*key)}, 1, 8) AS BIGINT) / 4294967296.0)"


@query("reservoir_per_class", f"SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY {_md5(4711, 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')}, l_orderkey, l_linenumber, l_partkey, l_suppkey) <= 50")
def reservoir_per_class(spark, d):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return sampling.reservoir(table(spark, d, "lineitem").select("l_returnflag", *key), 50, key, ["l_returnflag"]).select("l_returnflag", *key)


@query("class_uniform_samples", f"WITH {PIX} SELECT image_id, x, y, label FROM pix WHERE valid = 1 AND label <> 2 QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_md5(4711, 'image_id', 'x', 'y')}, image_id, x, y) <= 134")
def class_uniform_samples(spark, d):
    return sampling.class_uniform(pixels(spark, d), 4, 100, 4, [2]).select("image_id", "x", "y", "label")


@query("image_subsample", f"SELECT vec_id AS image_id FROM embeddings QUALIFY row_number() OVER (ORDER BY {_md5(4711, 3, 'vec_id')}, vec_id) <= 100")
def image_subsample(spark, d):
    return sampling.image_subsample(table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id")), 100, 3).select("image_id")


@query("pixel_uniform", f"SELECT id AS draw_id, {_draw(0, 99, 4711, chr(39) + 'image', 'id', 0)} AS image, CAST({_draw(0, 7, 4711, chr(39) + 'x', 'id', 0)} AS INTEGER) AS x, CAST({_draw(0, 7, 4711, chr(39) + 'y', 'id', 0)} AS INTEGER) AS y FROM range(1000) t(id)")
def pixel_uniform(spark, d):
    return sampling.pixel_uniform(spark, 1000, 100, 8, 8)


def _accepted_sql() -> str:
    image = f"(CAST('0x' || substr({_md5(4711, chr(39) + 'image', 'id', 'a')}, 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings))"
    return f"""WITH {PIX}, im AS (SELECT vec_id AS image_id, row_number() OVER (ORDER BY vec_id) - 1 AS image FROM embeddings),
t AS (SELECT id AS draw_id, a, {image} AS image, {_draw(0, 7, 4711, chr(39) + 'x', 'id', 'a')} AS x, {_draw(0, 7, 4711, chr(39) + 'y', 'id', 'a')} AS y FROM range(500) r(id), range(16) s(a))
SELECT draw_id, pix.image_id, pix.x, pix.y, pix.label FROM t JOIN im USING (image) JOIN pix ON pix.image_id = im.image_id AND pix.x = t.x AND pix.y = t.y WHERE label <> 1 QUALIFY row_number() OVER (PARTITION BY draw_id ORDER BY a) = 1"""


@query("pixel_uniform_accepted", _accepted_sql())
def pixel_uniform_accepted(spark, d):
    from pyspark.sql import Window

    im = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), (F.row_number().over(Window.orderBy("vec_id")) - 1).cast("long").alias("image"))
    return sampling.pixel_uniform_accepted(pixels(spark, d), im, 500, 8, 8, [1])


@query("random_split", f"SELECT doc_id, CASE WHEN {_unit(17, 'doc_id')} < 0.2 THEN 'test' ELSE 'train' END AS side FROM documents")
def random_split(spark, d):
    return sampling.split_sides(table(spark, d, "documents").select("doc_id"), "doc_id", 0.2, 17)


@query("five_runs", f"SELECT run, CASE WHEN {_unit(17, 'run', 'o_orderkey')} < 0.2 THEN 'test' ELSE 'train' END AS side, count(*) AS n FROM orders, range(5) r(run) GROUP BY ALL")
def five_runs(spark, d):
    return sampling.runs(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5, 0.2, 17).groupBy(F.col("run").cast("long").alias("run"), "side").agg(F.count(F.lit(1)).alias("n"))


@query("uniform_sampler", f"SELECT id, {_draw(-5, 5, 99, 'id', chr(39) + 'u')} AS value FROM range(200) t(id)")
def uniform_sampler(spark, d):
    return spark.range(200).select("id", hashing.draw(-5, 5, 99, F.col("id"), "u").alias("value"))


# --- features ----------------------------------------------------------------------------------------------------------------------

N, RADIUS, REGION, SEED = 16, 3, 2, 7


def feature_rows(spark):
    return feat.feature_table(spark, N, RADIUS, REGION, SEED)


def _feature_sql(seed: int = SEED) -> str:
    at = lambda name: f"CAST({_draw(-RADIUS, RADIUS, seed, 'id', chr(39) + name)} AS INTEGER)"
    box = lambda name: f"CAST({_draw(1, REGION, seed, 'id', chr(39) + name)} AS INTEGER)"
    tries = ", ".join(f"CASE WHEN {at(f'o2x{k}')} <> o1x OR {at(f'o2y{k}')} <> o1y THEN {{'x': {at(f'o2x{k}')}, 'y': {at(f'o2y{k}')}}} END" for k in range(feat.REDRAWS))
    ch = lambda part: f"CASE WHEN id >= {N // 2} THEN CAST(floor(id / CAST({N / 2.0 / part!r} AS DOUBLE) * 3) AS INTEGER) % 3 ELSE 0 END"
    return f"""f0 AS (SELECT id, {at('o1x')} AS o1x, {at('o1y')} AS o1y, {', '.join(f'{box(c)} AS {c}' for c in ('r1x', 'r1y', 'r2x', 'r2y'))} FROM range({N}) t(id)),
f1 AS (SELECT *, coalesce({tries}, {{'x': CAST(CASE WHEN o1x < {RADIUS} THEN o1x + 1 ELSE o1x - 1 END AS INTEGER), 'y': o1y}}) AS o2 FROM f0),
feat AS (SELECT CAST(id AS INTEGER) AS feature_id, CASE WHEN id >= {N // 2} THEN 'color' ELSE 'depth' END AS type, o1x, o1y, r1x, r1y, o2.x AS o2x, o2.y AS o2y, r2x, r2y, {ch(1)} AS ch1, {ch(3)} AS ch2 FROM f1)"""


FEAT = _feature_sql()
SAMP = f"samp AS (SELECT image_id * 64 + y * 8 + x AS sample_id, image_id, x, y, depth, label FROM pix WHERE valid = 1 QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_md5(4711, 'image_id', 'x', 'y')}, image_id, x, y) <= 100)"


def _response_sql(sign: int, features: str = FEAT, samples: str = SAMP) -> str:
    near = lambda c: f"CAST(trunc(CAST(f.{c} / CAST(CAST(s.depth / 1000.0 AS FLOAT) AS DOUBLE) AS FLOAT)) AS INTEGER)"
    box = lambda k: f"""b{k} AS (SELECT q.sample_id, q.feature_id, CASE WHEN q.type = 'color' THEN sum(CASE q.ch{k} WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END) WHEN sum(p.valid) > 0 THEN sum(p.depth) / 1000.0 / sum(p.valid) END AS v
 FROM (SELECT s.sample_id, f.feature_id, f.type, f.ch{k}, s.image_id, s.x + {sign} * {near(f'o{k}x')} AS cx, s.y + {near(f'o{k}y')} AS cy, greatest(1, {near(f'r{k}x')}) AS w, greatest(1, {near(f'r{k}y')}) AS h FROM samp s CROSS JOIN feat f) q
 JOIN pix p ON p.image_id = q.image_id AND p.x > cx - w AND p.x <= cx + w AND p.y > cy - h AND p.y <= cy + h WHERE cx - w >= 0 AND cx + w < 8 AND cy - h >= 0 AND cy + h < 8 GROUP BY q.sample_id, q.feature_id, q.type)"""  # noqa: E731
    return f"{PIX}, {features}, {samples}, {box(1)}, {box(2)}, resp AS (SELECT s.sample_id, s.label, s.image_id, f.feature_id, CAST(b1.v - b2.v AS DOUBLE) AS response FROM samp s CROSS JOIN feat f LEFT JOIN b1 USING (sample_id, feature_id) LEFT JOIN b2 USING (sample_id, feature_id))"


def samples_of(spark, d) -> DataFrame:
    some = sampling.reservoir(pixels(spark, d).where("valid = 1"), 100, ["image_id", "x", "y"], ["label"])
    return some.select((F.col("image_id") * 64 + F.col("y") * 8 + F.col("x")).alias("sample_id"), "image_id", "x", "y", "depth", "label")


def sampled_packs(spark, d) -> DataFrame:
    one = lambda c: F.transform("s", lambda s: s[c])
    lists = samples_of(spark, d).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("sample_id", "x", "y", "depth", "label"))).alias("s"))
    lists = lists.select("image_id", one("sample_id").alias("sid"), one("x").alias("sx"), one("y").alias("sy"), one("depth").alias("sdepth"), one("label").alias("slabel"))
    return forest.image_packs(pixels(spark, d)).join(lists, "image_id")


def responses(spark, d, flip: bool = False) -> DataFrame:
    return feat.response_rows(sampled_packs(spark, d), feat.Features.of(feature_rows(spark)), flip)


@query("feature_table_stratified", f"WITH {FEAT} SELECT * FROM feat")
def feature_table_stratified(spark, d):
    return feature_rows(spark)


@query("feature_sort", f"WITH {FEAT} SELECT feature_id, CAST(row_number() OVER (ORDER BY CASE type WHEN 'depth' THEN 0 ELSE 1 END, ch1, ch2, o1y, o1x, feature_id) - 1 AS INTEGER) AS sorted_id FROM feat")
def feature_sort(spark, d):
    return feat.in_order(feature_rows(spark)).select("feature_id", "sorted_id")


@query("feature_response", f"WITH {_response_sql(1)} SELECT sample_id, feature_id, round(response, 9) + 0.0 AS response FROM resp")
def feature_response(spark, d):
    return responses(spark, d).select("sample_id", "feature_id", (F.round("response", 9) + 0.0).alias("response"))


@query("feature_response_flip", f"WITH {_response_sql(-1)} SELECT sample_id, feature_id, round(response, 9) + 0.0 AS response FROM resp")
def feature_response_flip(spark, d):
    return responses(spark, d, flip=True).select("sample_id", "feature_id", (F.round("response", 9) + 0.0).alias("response"))


THR = f"{_response_sql(1)}, thr AS (SELECT feature_id, CAST(row_number() OVER (PARTITION BY feature_id ORDER BY response, sample_id) - 1 AS INTEGER) AS threshold_id, CAST(response AS FLOAT) AS value FROM (SELECT * FROM resp WHERE response IS NOT NULL QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY {_md5(5, 'feature_id', 'sample_id')}, feature_id, sample_id) <= 4))"


@query("thresholds_from_samples", f"WITH {THR} SELECT feature_id, threshold_id, round(CAST(value AS DOUBLE), 4) AS value FROM thr")
def thresholds_from_samples(spark, d):
    return feat.thresholds_from(responses(spark, d), 4, 5).select("feature_id", "threshold_id", F.round(F.col("value").cast("double"), 4).alias("value"))


def _gain_sql(cells: str, by: str) -> str:
    """The formulas as published, over ``cells`` (by, label, l, r)."""
    return f"""s AS (SELECT {by}, sum(l) AS sl, sum(r) AS sr, sum(l + r) AS n FROM {cells} GROUP BY {by}),
g AS (SELECT {by}, sum(CASE WHEN l > 0 THEN l / CAST(n AS DOUBLE) * log2((l / CAST(n AS DOUBLE)) / (sl / CAST(n AS DOUBLE) * ((l + r) / CAST(n AS DOUBLE)))) ELSE 0 END + CASE WHEN r > 0 THEN r / CAST(n AS DOUBLE) * log2((r / CAST(n AS DOUBLE)) / (sr / CAST(n AS DOUBLE) * ((l + r) / CAST(n AS DOUBLE)))) ELSE 0 END) AS ig,
  sum(CASE WHEN l + r > 0 THEN -(l + r) * log2(CAST(l + r AS DOUBLE)) ELSE 0 END) AS ec, any_value(sl) AS sl, any_value(sr) AS sr, any_value(n) AS n FROM {cells} JOIN s USING ({by}) GROUP BY {by}),
e AS (SELECT *, (CASE WHEN sl > 0 THEN -sl * log2(CAST(sl AS DOUBLE)) ELSE 0 END + CASE WHEN sr > 0 THEN -sr * log2(CAST(sr AS DOUBLE)) ELSE 0 END + n * log2(CAST(n AS DOUBLE))) / n AS hs, (ec + n * log2(CAST(n AS DOUBLE))) / n AS hc FROM g),
score AS (SELECT {by}, CAST(sl AS BIGINT) AS n_left, CAST(sr AS BIGINT) AS n_right, round(greatest(0, least(1, ig)), 9) + 0.0 AS gain, round(CASE WHEN sl = 0 OR sr = 0 OR abs(ig) < 1e-12 THEN 0 ELSE greatest(0, least(1, 2 * ig / (hs + hc))) END, 9) + 0.0 AS score FROM e)"""


EMB = f"""{THR}, cells AS (SELECT image_id % 3 AS node, feature_id, threshold_id, label, count(*) FILTER (WHERE response <= CAST(value AS DOUBLE)) AS l, count(*) FILTER (WHERE response > CAST(value AS DOUBLE) OR response IS NULL) AS r FROM resp JOIN thr USING (feature_id) GROUP BY ALL),
{_gain_sql('cells', 'node, feature_id, threshold_id')}"""


def embedding_scores(spark, d):
    rows = responses(spark, d).join(samples_of(spark, d).select("sample_id", "label", (F.col("image_id") % 3).alias("node")), "sample_id")
    counts = splits.split_counters(rows, feat.thresholds_from(responses(spark, d), 4, 5), ["node"])
    return scoring.gains(counts, ["node", "feature_id", "threshold_id"])


@query("split_scores_embeddings", f"WITH {EMB} SELECT * FROM score")
def split_scores_embeddings(spark, d):
    return rounded(embedding_scores(spark, d))


@query("best_split_embeddings", f"WITH {EMB} SELECT node, feature_id, threshold_id, n_left, n_right, gain, score FROM score QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, threshold_id, feature_id) = 1")
def best_split_embeddings(spark, d):
    return rounded(scoring.best(embedding_scores(spark, d), ["node"], 9))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"gain": F.round("gain", 9) + 0.0, "score": F.round("score", 9) + 0.0})


# --- scores over rows at volume ----------------------------------------------------------------------------------------------------

SPLITS = {"l_quantity": [10.0, 20.0, 30.0, 40.0], "l_extendedprice": [20000.0, 40000.0, 60000.0, 80000.0], "l_discount": [0.02, 0.04, 0.06, 0.08], "l_tax": [0.01, 0.03, 0.05, 0.07]}
_TH = ", ".join(f"({i}, {k}, CAST({v!r} AS DOUBLE))" for i, t in enumerate(SPLITS.values()) for k, v in enumerate(t))
_LONG = " UNION ALL ".join(f"SELECT l_linestatus AS node, l_returnflag AS label, {i} AS feature_id, {c} AS v FROM lineitem" for i, c in enumerate(SPLITS))
ITEM = f"th(feature_id, threshold_id, threshold) AS (VALUES {_TH}), long AS ({_LONG}), cells AS (SELECT node, CAST(feature_id AS INTEGER) AS feature_id, CAST(threshold_id AS INTEGER) AS threshold_id, label, count(*) FILTER (WHERE v <= threshold) AS l, count(*) FILTER (WHERE v > threshold) AS r FROM long JOIN th USING (feature_id) GROUP BY ALL)"
GAIN = f"{ITEM}, {_gain_sql('cells', 'node, feature_id, threshold_id')}"


def item_counters(spark, d, items: DataFrame | None = None) -> DataFrame:
    items = (table(spark, d, "lineitem") if items is None else items).withColumnRenamed("l_linestatus", "node")
    counts = splits.bucket_counts(items, SPLITS, "l_returnflag", ["node"])
    return scoring.cumulative(counts, ["node", "feature_id"], splits.threshold_rows(spark, SPLITS).drop("threshold"))


def item_scores(spark, d) -> DataFrame:
    return scoring.gains(item_counters(spark, d), ["node", "feature_id", "threshold_id"])


@query("best_split_lineitem", f"WITH {GAIN} SELECT node, feature_id, threshold_id, n_left, n_right, gain, score FROM score QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, threshold_id, feature_id) = 1")
def best_split_lineitem(spark, d):
    return rounded(scoring.best(item_scores(spark, d), ["node"], 9))


@query("split_counters", f"WITH {ITEM} SELECT node, feature_id, threshold_id, label, l AS n_left, r AS n_right FROM cells")
def split_counters(spark, d):
    return item_counters(spark, d)


@query("counters_of_parts", f"WITH {ITEM} SELECT node, feature_id, threshold_id, label, l AS n_left, r AS n_right FROM cells")
def counters_of_parts(spark, d):
    """Counters of three parts of the items, added up, are those of all."""
    items = table(spark, d, "lineitem")
    return splits.summed(*[item_counters(spark, d, items.where(F.col("l_orderkey") % 3 == k)) for k in range(3)])


@query("info_gain", f"WITH {GAIN} SELECT node, feature_id, threshold_id, gain FROM score")
def info_gain(spark, d):
    return rounded(item_scores(spark, d)).select("node", "feature_id", "threshold_id", "gain")


@query("normalized_gain", f"WITH {GAIN} SELECT node, feature_id, threshold_id, n_left, n_right, score FROM score")
def normalized_gain(spark, d):
    return rounded(item_scores(spark, d)).select("node", "feature_id", "threshold_id", "n_left", "n_right", "score")


@query("noop_score", f"WITH {ITEM} SELECT node, feature_id, threshold_id, CAST(sum(l) AS BIGINT) AS n_left, CAST(sum(r) AS BIGINT) AS n_right, round(sum(l) / CAST(sum(l) + sum(r) AS DOUBLE), 9) AS score FROM cells GROUP BY ALL")
def noop_score(spark, d):
    return scoring.no_op_score(item_counters(spark, d), ["node", "feature_id", "threshold_id"]).withColumn("score", F.round("score", 9))


@query("class_prior", f"WITH {PIX} SELECT CAST(d AS INTEGER) AS label, count(pix.label) AS n FROM range(5) t(d) LEFT JOIN pix ON pix.label = d GROUP BY d")
def class_prior(spark, d):
    return splits.class_prior(pixels(spark, d), spark.range(5).select(F.col("id").cast("int").alias("label")))


@query("node_histogram", "SELECT l_linestatus AS node, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY ALL")
def node_histogram(spark, d):
    return splits.node_histogram(table(spark, d, "lineitem").withColumnRenamed("l_linestatus", "node"), ["node"], "l_returnflag")


@query("flip_histogram", f"WITH {PIX} SELECT label, 2 * count(*) AS n, count(*) AS n_samples FROM pix GROUP BY label")
def flip_histogram(spark, d):
    both = splits.flipped(pixels(spark, d).withColumn("sample_id", F.col("image_id") * 64 + F.col("y") * 8 + F.col("x")))
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("n_samples"))


GOLDEN = [("a", [5, 8], [3, 1]), ("b", [2, 8], [6, 1]), ("c", [56, 241, 290, 3, 18], [30, 0, 1, 0, 249]), ("d", [50, 100, 0, 0, 0], [0, 0, 50, 0, 100]), ("e", [7, 7], [7, 7]), ("f", [0, 14], [14, 0])]
_GOLD = ", ".join(f"('{k}', {i}, {a}, {b})" for k, left, right in GOLDEN for i, (a, b) in enumerate(zip(left, right)))


@query("golden_scores", f"WITH cells(case_id, label, l, r) AS (VALUES {_GOLD}), {_gain_sql('cells', 'case_id')} SELECT * FROM score")
def golden_scores(spark, d):
    rows = [(k, i, a, b) for k, left, right in GOLDEN for i, (a, b) in enumerate(zip(left, right))]
    return rounded(scoring.gains(spark.createDataFrame(rows, "case_id string, label int, n_left long, n_right long"), ["case_id"]))


@query("column_summary", "SELECT count(l_quantity) AS n, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem")
def column_summary(spark, d):
    return splits.summary(table(spark, d, "lineitem"), "l_quantity").withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


# --- metrics -----------------------------------------------------------------------------------------------------------------------

TP = "tp AS (SELECT doc_id, quality AS label, toxic AS prediction FROM labels)"


def truth(spark, d):
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


@query("confusion_matrix", f"WITH {TP} SELECT label, prediction, count(*) AS n FROM tp GROUP BY ALL")
def confusion_matrix(spark, d):
    return metrics.confusion(truth(spark, d))


@query("confusion_normalized", f"WITH {TP}, c AS (SELECT label, prediction, count(*) AS n FROM tp GROUP BY ALL) SELECT label, prediction, round(n / CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE), 9) AS share FROM c")
def confusion_normalized(spark, d):
    return metrics.normalized(metrics.confusion(truth(spark, d))).select("label", "prediction", F.round("share", 9).alias("share"))


_CA = f"WITH {TP}, c AS (SELECT label, avg(CAST(label = prediction AS INTEGER)) AS a FROM tp GROUP BY label) SELECT round(avg(coalesce(a, 0)), 9) AS class_accuracy FROM range(3) t(d) LEFT JOIN c ON label = d"


def _three(spark):
    return spark.range(3).select(F.col("id").cast("int").alias("label"))


@query("class_accuracy", _CA)
def class_accuracy(spark, d):
    return metrics.class_accuracy(metrics.confusion(truth(spark, d)), domain=_three(spark)).select(F.round("class_accuracy", 9).alias("class_accuracy"))


@query("class_accuracy_without_void", _CA + " WHERE d <> 0")
def class_accuracy_without_void(spark, d):
    return metrics.class_accuracy(metrics.confusion(truth(spark, d)), [0], False, _three(spark)).select(F.round("class_accuracy", 9).alias("class_accuracy"))


@query("pixel_accuracy", f"WITH {TP} SELECT round(avg(CAST(label = prediction AS INTEGER)), 9) AS pixel_accuracy FROM tp")
def pixel_accuracy(spark, d):
    return metrics.pixel_accuracy(truth(spark, d)).select(F.round("pixel_accuracy", 9).alias("pixel_accuracy"))


@query("pixel_accuracy_without_void", f"WITH {TP} SELECT round(avg(CAST(label = prediction AS INTEGER)), 9) AS pixel_accuracy FROM tp WHERE label <> 0")
def pixel_accuracy_without_void(spark, d):
    return metrics.pixel_accuracy(truth(spark, d), [0], False).select(F.round("pixel_accuracy", 9).alias("pixel_accuracy"))


@query("dataset_accuracy", f"WITH {TP} SELECT round(avg(a), 9) AS dataset_accuracy FROM (SELECT doc_id % 7 AS i, avg(CAST(label = prediction AS INTEGER)) AS a FROM tp GROUP BY i)")
def dataset_accuracy(spark, d):
    return metrics.dataset_accuracy(truth(spark, d).withColumn("i", F.col("doc_id") % 7), "i").select(F.round("dataset_accuracy", 9).alias("dataset_accuracy"))


_IMAGES = "(SELECT avg(a) FROM (SELECT avg(CAST(label = prediction AS INTEGER)) AS a FROM tp {} GROUP BY doc_id % 7))"
_SHARES = "(SELECT avg(coalesce(a, 0)) FROM range(3) t(d) LEFT JOIN c ON label = d {})"
_VALUES = dict(zip(metrics.LOSSES, (_SHARES.format(""), _SHARES.format("WHERE d <> 0"), _IMAGES.format(""), _IMAGES.format("WHERE label <> 0"))))


@query("losses", f"WITH {TP}, c AS (SELECT label, avg(CAST(label = prediction AS INTEGER)) AS a FROM tp GROUP BY label) " + " UNION ALL ".join(f"SELECT '{k}' AS kind, round(1 - {v}, 9) AS loss" for k, v in _VALUES.items()))
def losses(spark, d):
    """The four losses of one prediction."""
    rows = truth(spark, d).withColumn("i", F.col("doc_id") % 7)
    counts = metrics.confusion(rows)
    shares = [metrics.class_accuracy(counts, [0], void, _three(spark)) for void in (True, False)] + [metrics.dataset_accuracy(rows, "i", [0], void) for void in (True, False)]
    # Four single values.
    at = [F.lit(df.first()[0]) for df in shares]
    kinds = spark.createDataFrame([(k,) for k in metrics.LOSSES], "kind string")
    return kinds.select("kind", F.round(metrics.loss(F.col("kind"), *at), 9).alias("loss"))


@query("loss_mean_var", "SELECT event_type, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance FROM events GROUP BY event_type")
def loss_mean_var(spark, d):
    return metrics.mean_and_variance(table(spark, d, "events"), ["event_type"], "value").select("event_type", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


# --- applying models ---------------------------------------------------------------------------------------------------------------

HIST = "h AS (SELECT l_linenumber AS node, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY l_linenumber)"


def histograms(spark, d, some=None) -> DataFrame:
    count = lambda v: F.count_if(F.col("l_returnflag") == v)
    items = table(spark, d, "lineitem")
    return (items if some is None else items.where(some)).groupBy(F.col("l_linenumber").alias("node")).agg(F.array(*map(count, "ANR")).alias("histogram"))


def _norm_sql() -> str:
    left = {c: f"greatest(0, {c} - 0.1 * (a + n + r))" for c in "anr"}
    prior = {"a": 100, "n": 200, "r": 100}
    return f"WITH {HIST} SELECT node, " + ", ".join(f"round({left[c]} / ({' + '.join(left.values())}) * CAST({prior[c] / 400} AS DOUBLE), 9) AS {c}" for c in "anr") + " FROM h"


@query("normalize_histogram", _norm_sql())
def normalize_histogram(spark, d):
    norm = arrays.normalized(F.col("histogram"), F.array(F.lit(100), F.lit(200), F.lit(100)), 0.1)
    return histograms(spark, d).select("node", norm.alias("v")).select("node", *[F.round(F.get("v", F.lit(i)), 9).alias(c) for i, c in enumerate("anr")])


@query("dominant_class", f"WITH {HIST} SELECT node, CASE WHEN a >= n AND a >= r THEN 0 WHEN n >= r THEN 1 ELSE 2 END AS dominant FROM h")
def dominant_class(spark, d):
    return histograms(spark, d).select("node", arrays.dominant(F.col("histogram")).alias("dominant"))


@query("pure_nodes", "SELECT o_custkey AS node, count(DISTINCT o_orderstatus) = 1 AS pure FROM orders GROUP BY o_custkey")
def pure_nodes(spark, d):
    count = lambda v: F.count_if(F.col("o_orderstatus") == v)
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.array(*map(count, "FOP")).alias("h")).select("node", arrays.is_pure(F.col("h")).alias("pure"))


@query("histogram_sum", f"WITH {HIST} SELECT node, a, n, r FROM h")
def histogram_sum(spark, d):
    """Histograms of nodes over two parts of the items, added up, are those of all."""
    doubles = lambda part: F.transform("histogram", lambda x: x.cast("double")).alias(part)
    sides = [histograms(spark, d, F.col("l_orderkey") % 2 == k).select("node", doubles(f"part{k}")) for k in range(2)]
    both = sides[0].join(sides[1], "node", "full").select("node", *[F.coalesce(f"part{k}", F.array_repeat(F.lit(0.0), 3)).alias(f"part{k}") for k in range(2)])
    both = both.select("node", arrays.added(F.col("part0"), F.col("part1")).alias("v"))
    return both.select("node", *[F.get("v", F.lit(i)).cast("long").alias(c) for i, c in enumerate("anr")])


#: Two trees over columns of items, in breadth-first order: (id, left, right, column, threshold, distribution).
TREES = [
    [(0, 1, 2, "l_quantity", 25.0, None), (1, 3, 4, "l_discount", 0.05, None), (2, None, None, None, None, (0.1, 0.2, 0.7)), (3, None, None, None, None, (0.6, 0.2, 0.2)), (4, None, None, None, None, (0.3, 0.4, 0.3))],
    [(0, 1, 2, "l_extendedprice", 50000.0, None), (1, None, None, None, None, (0.5, 0.25, 0.25)), (2, 3, 4, "l_tax", 0.04, None), (3, None, None, None, None, (0.2, 0.5, 0.3)), (4, None, None, None, None, (0.1, 0.1, 0.8))],
]
_LEAF = ["CASE WHEN l_quantity <= 25 THEN CASE WHEN l_discount <= CAST(0.05 AS DOUBLE) THEN 3 ELSE 4 END ELSE 2 END", "CASE WHEN l_extendedprice <= 50000 THEN 1 ELSE CASE WHEN l_tax <= CAST(0.04 AS DOUBLE) THEN 3 ELSE 4 END END"]


def leaf(tree: int):
    nodes = [{"node_id": i, "left_id": a, "right_id": b, "feature": c, "threshold": t} for i, a, b, c, t, _ in TREES[tree]]
    return inference.tree_expression(nodes, F.col)


def votes():
    each = []
    for t, nodes in enumerate(TREES):
        dist = {n[0]: n[5] for n in nodes if n[5]}
        out = F.lit(None).cast("array<double>")
        for i, v in dist.items():
            out = F.when(leaf(t) == i, F.array(*map(F.lit, v))).otherwise(out)
        each.append(out)
    return arrays.voted(arrays.added(*each))


def _vote_sql() -> str:
    per = lambda t, k: "CASE " + " ".join(f"WHEN leaf{t} = {n[0]} THEN CAST({n[5][k]} AS DOUBLE)" for n in TREES[t] if n[5]) + " END"
    return f"w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, {_LEAF[0]} AS leaf0, {_LEAF[1]} AS leaf1 FROM lineitem), v AS (SELECT *, " + ", ".join(f"({per(0, k)} + {per(1, k)}) AS v{k}" for k in range(3)) + " FROM w), p AS (SELECT *, " + ", ".join(f"round(v{k} / (0.0 + v0 + v1 + v2), 9) AS p{k}" for k in range(3)) + " FROM v)"


@query("tree_classify", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_LEAF[0]} AS leaf FROM lineitem")
def tree_classify(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", leaf(0).alias("leaf"))


@query("forest_votes", f"WITH {_vote_sql()} SELECT p0, p1, p2, count(*) AS n FROM p GROUP BY ALL")
def forest_votes(spark, d):
    return table(spark, d, "lineitem").select(votes().alias("v")).select(*[F.round(F.get("v", F.lit(k)), 9).alias(f"p{k}") for k in range(3)]).groupBy("p0", "p1", "p2").agg(F.count(F.lit(1)).alias("n"))


@query("forest_predict", f"WITH {_vote_sql()} SELECT l_returnflag AS truth, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS prediction, count(*) AS n FROM p GROUP BY ALL")
def forest_predict(spark, d):
    rounded_votes = F.transform(votes(), lambda x: F.round(x, 9))
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("truth"), arrays.dominant(rounded_votes).alias("prediction")).groupBy("truth", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("improve_histograms", " UNION ALL ".join(f"SELECT {t} AS tree, {_LEAF[t]} AS leaf, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY ALL" for t in range(2)))
def improve_histograms(spark, d):
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), leaf(t).alias("leaf")) for t in range(2)])).alias("x")
    return table(spark, d, "lineitem").select("l_returnflag", each).groupBy("x.tree", "x.leaf", F.col("l_returnflag").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("samples_per_image", f"SELECT {_LEAF[0]} AS leaf, l_suppkey AS image_id, count(*) AS n FROM lineitem GROUP BY ALL")
def samples_per_image(spark, d):
    return table(spark, d, "lineitem").groupBy(leaf(0).alias("leaf"), F.col("l_suppkey").alias("image_id")).agg(F.count(F.lit(1)).alias("n"))


_NODES = [(t, n[0], next((p[0] for p in nodes if n[0] in (p[1], p[2])), None), n[1], n[2], n[1] is None) for t, nodes in enumerate(TREES) for n in nodes]
_NODE_SQL = "nodes(tree_id, node_id, parent_id, is_leaf) AS (VALUES " + ", ".join(f"({t}, {i}, {'NULL' if p is None else p}, {leaf_})" for t, i, p, _, _, leaf_ in _NODES) + ")"


@query("tree_path", f"WITH RECURSIVE {_NODE_SQL}, walk AS (SELECT tree_id, node_id, 0 AS depth, CAST(node_id AS VARCHAR) AS path FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.tree_id, n.node_id, depth + 1, path || '/' || n.node_id FROM walk w JOIN nodes n ON n.tree_id = w.tree_id AND n.parent_id = w.node_id) SELECT tree_id, CAST(node_id AS BIGINT) AS node_id, depth, path FROM walk")
def tree_path(spark, d):
    return inference.paths(spark.createDataFrame(_NODES, "tree_id int, node_id long, parent_id long, left_id long, right_id long, is_leaf boolean"))


@query("leaf_nodes", f"WITH {_NODE_SQL} SELECT tree_id, CAST(node_id AS BIGINT) AS node_id FROM nodes WHERE is_leaf")
def leaf_nodes(spark, d):
    return inference.leaves(spark.createDataFrame(_NODES, "tree_id int, node_id long, parent_id long, left_id long, right_id long, is_leaf boolean")).select("tree_id", "node_id")


# --- growing, files, tuning --------------------------------------------------------------------------------------------------------
# A level of growth has SQL, and what walks, stores and counts trees; deeper forests and searches are held against brute force.

SMALL = TrainingConfig(trees=2, samples_per_image=8, feature_count=24, thresholds=6, max_depth=5, box_radius=3, region_size=2, min_sample_count=8, horizontal_flipping=True)
LEVEL = SMALL.with_(feature_count=N, box_radius=RADIUS, region_size=REGION, max_depth=2, horizontal_flipping=False)


def labeler(spark, d) -> forest.RandomForestLabeler:
    return forest.RandomForestLabeler(SMALL).fit(pixels(spark, d), 4)


def _grown_sql(tree: int) -> str:
    """A tree's root and its children: samples, features and thresholds drawn, every split scored, the best one taken."""
    seed = LEVEL.random_seed + tree
    few = f"(SELECT CAST(ceil(count(*) * {LEVEL.samples_per_tree} / 4.0) AS BIGINT) FROM embeddings)"
    sid = f"CAST('0x' || substr({_md5(chr(39) + 'sample', tree, 'image_id', 'x', 'y')}, 1, 13) AS BIGINT)"
    samp = f"samp AS (SELECT image_id * 64 + y * 8 + x AS sample_id, image_id, x, y, depth, label, {sid} AS sid FROM pix WHERE valid = 1 QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_md5(seed, 'image_id', 'x', 'y')}, image_id, x, y) <= {few})"
    ring = forest.SIDS
    count = lambda side: ", ".join(f"CAST(sum({side}) FILTER (WHERE label = {k}) AS BIGINT) AS h{k}" for k in range(4))
    drawn = _feature_sql(LEVEL.random_seed + tree * 1_000_003 + 1).replace("feat AS (", "feats AS (", 1)
    sorted_ = "feat AS (SELECT * REPLACE (CAST(row_number() OVER (ORDER BY CASE type WHEN 'depth' THEN 0 ELSE 1 END, ch1, ch2, o1y, o1x, feature_id) - 1 AS INTEGER) AS feature_id) FROM feats)"
    return f"""(WITH {_response_sql(1, f"{drawn}, {sorted_}", samp)},
pick AS (SELECT feature_id, k, {_draw(0, 2**32 - 1, seed, 1, 'feature_id', 'k')} * {ring >> 32} AS place FROM feat, range({LEVEL.thresholds}) r(k)),
chosen AS (SELECT feature_id, k, arg_min(coalesce(response, 0.0), ((sid - place) % {ring} + {ring}) % {ring}) AS v FROM pick JOIN resp USING (feature_id) JOIN samp USING (sample_id) GROUP BY feature_id, k),
thr AS (SELECT feature_id, CAST(row_number() OVER (PARTITION BY feature_id ORDER BY CAST(v AS FLOAT)) - 1 AS INTEGER) AS threshold_id, CAST(v AS FLOAT) AS value FROM chosen),
cells AS (SELECT feature_id, threshold_id, label, count(*) FILTER (WHERE response <= CAST(value AS DOUBLE)) AS l, count(*) FILTER (WHERE response > CAST(value AS DOUBLE) OR response IS NULL) AS r FROM resp JOIN thr USING (feature_id) GROUP BY ALL),
{_gain_sql('cells', 'feature_id, threshold_id')},
best AS (SELECT feature_id, threshold_id, n_left, n_right, score FROM score ORDER BY score DESC, threshold_id, feature_id LIMIT 1),
side AS (SELECT any_value(n_left) AS nl, any_value(n_right) AS nr, feature_id, threshold_id, any_value(score) AS score, {', '.join(f"CAST(coalesce(sum(l) FILTER (WHERE label = {k}), 0) AS BIGINT) AS l{k}, CAST(coalesce(sum(r) FILTER (WHERE label = {k}), 0) AS BIGINT) AS r{k}" for k in range(4))} FROM best JOIN cells USING (feature_id, threshold_id) GROUP BY feature_id, threshold_id)
SELECT {tree} AS tree_id, CAST(0 AS BIGINT) AS node_id, 1 AS level, false AS is_leaf, nl + nr AS n_samples, {', '.join(f'l{k} + r{k} AS h{k}' for k in range(4))}, feature_id, round(CAST(value AS DOUBLE), 4) AS threshold, score FROM side JOIN thr USING (feature_id, threshold_id)
UNION ALL SELECT {tree}, 1, 2, true, nl, l0, l1, l2, l3, NULL, NULL, NULL FROM side
UNION ALL SELECT {tree}, 2, 2, true, nr, r0, r1, r2, r3, NULL, NULL, NULL FROM side)"""


@query("train_tree_levels", f"{_grown_sql(0)} UNION ALL {_grown_sql(1)}")
def train_tree_levels(spark, d):
    """The first level of two trees: what is drawn, counted, scored and split."""
    nodes = forest.RandomForestLabeler(LEVEL).fit(pixels(spark, d), 4).node_table(spark)
    return nodes.select("tree_id", "node_id", "level", "is_leaf", "n_samples", *[F.get("histogram", F.lit(k)).alias(f"h{k}") for k in range(4)], F.col("feature.feature_id").alias("feature_id"), F.round(F.col("threshold").cast("double"), 4).alias("threshold"), F.round("score", 9).alias("score"))


@query("train_forest")
def train_forest(spark, d):
    return labeler(spark, d).node_table(spark).select("tree_id", "node_id", "level", "parent_id", "is_leaf", "n_samples", F.col("threshold").cast("double").alias("threshold"), F.round("score", 9).alias("score"))


HEAP = """heap AS (SELECT CAST(p_partkey % 5 AS INTEGER) AS tree_id, row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey) - 1 AS node_id, count(*) OVER (PARTITION BY p_partkey % 5) AS n, p_partkey AS k, p_size AS z FROM part),
nodes AS (SELECT tree_id, node_id, CAST(floor(log2(node_id + 1)) AS INTEGER) + 1 AS level, CASE WHEN node_id > 0 THEN (node_id - 1) // 2 END AS parent_id, NOT inner_ AS is_leaf, CASE WHEN inner_ THEN 2 * node_id + 1 END AS left_id, CASE WHEN inner_ THEN 2 * node_id + 2 END AS right_id,
  k % 7 + z AS n_samples, k % 7 AS h0, CAST(z AS BIGINT) AS h1, CASE WHEN inner_ THEN CASE WHEN k % 2 = 0 THEN 'color' ELSE 'depth' END END AS type, CASE WHEN inner_ THEN z END AS o1x, CASE WHEN inner_ THEN CASE WHEN k % 2 = 0 THEN CAST(k % 3 AS INTEGER) ELSE 0 END END AS ch2,
  CASE WHEN inner_ THEN z / CAST(8 AS DOUBLE) END AS threshold, CASE WHEN inner_ THEN z / CAST(64 AS DOUBLE) END AS score FROM (SELECT *, 2 * node_id + 2 < n AS inner_ FROM heap WHERE node_id < n - (n + 1) % 2))"""


def heaps(spark, d) -> DataFrame:
    """Parts as the nodes of five full binary trees, numbered breadth first."""
    from pyspark.sql import Window

    tree = (F.col("p_partkey") % 5).cast("int")
    one = Window.partitionBy(tree)
    rows = table(spark, d, "part").select(tree.alias("tree_id"), (F.row_number().over(one.orderBy("p_partkey")) - 1).cast("long").alias("node_id"), F.count(F.lit(1)).over(one).alias("n"), F.col("p_partkey").alias("k"), F.col("p_size").cast("int").alias("z"))
    rows = rows.where("node_id < n - (n + 1) % 2").withColumn("inner", F.expr("2 * node_id + 2 < n"))
    split = lambda c: F.when(F.col("inner"), c)
    number = lambda c: (F.lit(c) if isinstance(c, int) else c).cast("int")
    color = F.col("k") % 2 == 0
    named = {"feature_id": 3, "o1x": F.col("z"), "o1y": -1, "r1x": 1, "r1y": 2, "o2x": 4, "o2y": 5, "r2x": 6, "r2y": 7, "ch1": 0, "ch2": F.when(color, F.col("k") % 3).otherwise(0)}
    feature = F.struct(number(named.pop("feature_id")).alias("feature_id"), F.when(color, "color").otherwise("depth").alias("type"), *[number(v).alias(c) for c, v in named.items()])
    return rows.select("tree_id", "node_id", (F.floor(F.log2(F.col("node_id") + 1)) + 1).cast("int").alias("level"), F.when(F.col("node_id") > 0, F.floor((F.col("node_id") - 1) / 2)).alias("parent_id"), split(2 * F.col("node_id") + 1).alias("left_id"), split(2 * F.col("node_id") + 2).alias("right_id"), (~F.col("inner")).alias("is_leaf"),
        (F.col("k") % 7 + F.col("z")).cast("long").alias("n_samples"), F.array(F.col("k") % 7, F.col("z").cast("long")).alias("histogram"), split(feature).alias("feature"), split(F.col("z") / 8.0).alias("threshold"), split(F.col("z") / 64.0).alias("score"))


@query("tree_stats", f"WITH {HEAP} SELECT tree_id, count(*) AS n_nodes, count(*) FILTER (WHERE is_leaf) AS n_leaves, max(level) - min(level) + 1 AS depth, count(*) FILTER (WHERE type = 'color') AS n_color, count(*) FILTER (WHERE type = 'depth') AS n_depth FROM nodes GROUP BY tree_id")
def tree_stats(spark, d):
    return inference.tree_stats(heaps(spark, d))


#: Two trees over two features of pixels: (node, left, right, feature, threshold, distribution).
PIXEL_TREES = [
    [(0, 1, 2, 9, 40.0, None), (1, 3, 4, 2, 0.0, None), (2, None, None, None, None, (0.1, 0.2, 0.3, 0.4)), (3, None, None, None, None, (0.7, 0.1, 0.1, 0.1)), (4, None, None, None, None, (0.25, 0.5, 0.125, 0.125))],
    [(0, 1, 2, 12, -25.0, None), (1, None, None, None, None, (0.0, 0.0, 0.75, 0.25)), (2, 3, 4, 5, 0.125, None), (3, None, None, None, None, (0.2, 0.2, 0.2, 0.4)), (4, None, None, None, None, (0.5, 0.0, 0.0, 0.5))],
]


def pixel_forest(spark) -> list[inference.Tree]:
    rows = {r.feature_id: r.asDict() for r in feature_rows(spark).collect()}
    blank = {"histogram": [0] * 4}
    return inference.forest_of([blank | {"tree_id": t, "node_id": i, "left_id": a, "right_id": b, "feature": rows[f] if f is not None else None, "threshold": v, "norm_hist": list(dist or (0.0,) * 4)} for t, nodes in enumerate(PIXEL_TREES) for i, a, b, f, v, dist in nodes])


def _walk_sql() -> str:
    wanted = sorted({n[3] for nodes in PIXEL_TREES for n in nodes if n[3] is not None})
    every = "samp AS (SELECT image_id * 64 + y * 8 + x AS sample_id, image_id, x, y, depth, label FROM pix WHERE valid = 1)"
    some = f"{FEAT.replace('feat AS (', 'feats AS (', 1)}, feat AS (SELECT * FROM feats WHERE feature_id IN ({', '.join(map(str, wanted))}))"

    def walk(nodes: list, i: int) -> str:
        _, left, right, f, v, _ = nodes[i]
        return str(i) if left is None else f"CASE WHEN f{f} <= CAST({v} AS DOUBLE) THEN {walk(nodes, left)} ELSE {walk(nodes, right)} END"

    wide = ", ".join(f"max(response) FILTER (WHERE feature_id = {f}) AS f{f}" for f in wanted)
    return f"{_response_sql(1, some, every)}, wide AS (SELECT sample_id, {wide} FROM resp GROUP BY sample_id), walked AS (SELECT image_id, x, y, label, " + ", ".join(f"{walk(nodes, 0)} AS leaf{t}" for t, nodes in enumerate(PIXEL_TREES)) + " FROM (SELECT *, image_id * 64 + y * 8 + x AS sample_id FROM pix) LEFT JOIN wide USING (sample_id))"


def _label_sql() -> str:
    say = lambda t, k: f"CASE leaf{t} " + " ".join(f"WHEN {n[0]} THEN CAST({n[5][k]} AS DOUBLE)" for n in PIXEL_TREES[t] if n[5]) + " END"
    votes = ", ".join(f"{say(0, k)} + {say(1, k)} AS v{k}" for k in range(4))
    return f"WITH {_walk_sql()}, voted AS (SELECT *, {votes} FROM walked) SELECT image_id, x, y, CAST(CASE WHEN v0 >= v1 AND v0 >= v2 AND v0 >= v3 THEN 0 WHEN v1 >= v2 AND v1 >= v3 THEN 1 WHEN v2 >= v3 THEN 2 ELSE 3 END AS INTEGER) AS prediction FROM voted"


@query("label_all_pixels", _label_sql())
def label_all_pixels(spark, d):
    return inference.predicted(forest.image_packs(pixels(spark, d)), pixel_forest(spark))


@query("count_pixels_in_leaves", f"WITH {_walk_sql()} " + " UNION ALL ".join(f"SELECT {t} AS tree, CAST(leaf{t} AS BIGINT) AS leaf, label, count(*) AS n FROM walked GROUP BY ALL" for t in range(2)))
def count_pixels_in_leaves(spark, d):
    return inference.leaf_counts(forest.image_packs(pixels(spark, d)), pixel_forest(spark))


@query("forest_label_pixels")
def forest_label_pixels(spark, d):
    return labeler(spark, d).predict(pixels(spark, d))


@query("pixel_histograms")
def pixel_histograms(spark, d):
    model = labeler(spark, d)
    return inference.leaf_counts(forest.image_packs(pixels(spark, d)), inference.forest_of(model.normalized_nodes(spark)))


@query("model_round_trip", f"WITH {HEAP} SELECT tree_id, node_id, level, parent_id, is_leaf, left_id, right_id, n_samples, h0, h1, type, o1x, ch2, threshold, score FROM nodes")
def model_round_trip(spark, d):
    """Five trees written as nested files and read again, node by node."""
    folder = forest.shared_path(spark, "model")
    model_json.write_forest(spark, folder, heaps(spark, d), LEVEL.with_(trees=5, samples_per_image=10), [3, 4], {0: "0,0,0", 1: "1,2,3"})
    again, config, priors, colors = model_json.read_nodes(spark, folder)
    if config.trees != 5 or priors != [3, 4] or colors != {0: "0,0,0", 1: "1,2,3"}:
        raise ValueError("the settings, priors or colours of a forest came back changed")
    one = lambda c: F.col(f"feature.{c}").alias(c)
    return again.select("tree_id", "node_id", "level", "parent_id", "is_leaf", "left_id", "right_id", "n_samples", *[F.get("histogram", F.lit(k)).alias(f"h{k}") for k in range(2)], one("type"), one("o1x"), one("ch2"), "threshold", "score")


@query("image_round_trip", f"WITH {PIX} SELECT image_id, x, y, depth, CAST(abs(c0) % 256 AS BIGINT) AS red FROM pix")
def image_round_trip(spark, d):
    """Colour and depth images of all grids, written as PNG and read again."""
    px = pixels(spark, d).withColumn("red", F.abs("c0") % 256)
    folder = forest.shared_path(spark, "images")
    images.save_images(images.images_of(px, ["red", "red", "red"]), folder, images.COLORS)
    images.save_images(images.images_of(px, ["depth"], sixteen=True), folder, images.DEPTH)
    back = images.read_images(spark, folder, truth=False)
    return back.select(F.regexp_extract("stem", r"([0-9]+)$", 1).cast("long").alias("image_id"), "x", "y", "depth", F.col("c0").cast("long").alias("red"))


@query("t_statistic", "SELECT round((avg(value) FILTER (WHERE event_type = 'view') - avg(value) FILTER (WHERE event_type = 'click')) / (sqrt(((count(*) FILTER (WHERE event_type = 'view') - 1) * var_pop(value) FILTER (WHERE event_type = 'view') + (count(*) FILTER (WHERE event_type = 'click') - 1) * var_pop(value) FILTER (WHERE event_type = 'click')) / (count(*) FILTER (WHERE event_type IN ('view', 'click')) - 2)) * sqrt(1.0 / count(*) FILTER (WHERE event_type = 'view') + 1.0 / count(*) FILTER (WHERE event_type = 'click'))), 6) AS t, count(*) FILTER (WHERE event_type IN ('view', 'click')) - 2 AS dof FROM events")
def t_statistic(spark, d):
    t, dof = stats.t_statistic("event_type = 'view'", "event_type = 'click'")
    return table(spark, d, "events").withColumnRenamed("value", "loss").agg(F.round(t, 6).alias("t"), dof.alias("dof"))


def _tail_sql() -> str:
    """P(T > |t|), Student's density integrated by Simpson's rule over 2000 steps."""
    density = lambda x: f"exp(lgamma((dof + 1) / 2.0) - lgamma(dof / 2.0) - ln(dof * pi()) / 2 - (dof + 1) / 2.0 * ln(1 + ({x}) * ({x}) / dof))"
    return f"""0.5 - (SELECT sum(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {density('least(abs(t), 60.0) * i / 2000.0')}) * least(abs(t), 60.0) / 6000.0 FROM range(2001) r(i))"""


_KEEP = f"""WITH runs AS (SELECT event_type, value + CASE WHEN event_type = 'view' THEN 0 ELSE 400 END AS loss FROM events),
g AS (SELECT event_type, count(loss) AS n, avg(loss) AS m, var_pop(loss) AS v, min(loss) AS low, max(loss) AS high FROM runs GROUP BY event_type),
b AS (SELECT n AS bn, m AS bm, v AS bv, high AS worst FROM g WHERE event_type = 'view'),
j AS (SELECT *, n + bn - 2 AS dof, (bm - m) / (sqrt(((bn - 1) * bv + (n - 1) * v) / (n + bn - 2)) * sqrt(1.0 / bn + 1.0 / n)) AS t FROM g, b)
SELECT event_type, round(t, 6) AS t, dof, n < 3 OR low <= worst OR ({_tail_sql()}) > 0.005 AS keep_going FROM j"""


@query("continue_search", _KEEP)
def continue_search(spark, d):
    runs = table(spark, d, "events").select("event_type", (F.col("value") + F.when(F.col("event_type") == "view", 0).otherwise(400)).alias("loss"))
    return stats.keep_going(runs, "event_type", "view").withColumn("t", F.round("t", 6))


@query("trial_best", "SELECT event_type, event_id AS trial_id, value AS loss FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) = 1")
def trial_best(spark, d):
    return tuning.best_trial(table(spark, d, "events").select("event_type", F.col("event_id").alias("trial_id"), F.col("value").alias("loss")), ["event_type"])


@query("search_space", "SELECT id AS trial_id, " + ", ".join((f"round({_unit(3, 'id', chr(39) + n)} * {hi - lo} + {lo})" if whole else f"{_unit(3, 'id', chr(39) + n)} * CAST({hi - lo} AS DOUBLE) + CAST({lo} AS DOUBLE)") + f" AS \"{n}\"" for n, (lo, hi, whole) in tuning.SPACE.items()) + " FROM range(100) t(id)")
def search_space(spark, d):
    return tuning.proposals(spark, 100, 3)


@query("trial_parameters", "SELECT event_id, value AS \"boxRadius\" FROM events")
def trial_parameters(spark, d):
    task = F.create_map(F.lit("boxRadius"), F.array("value"))
    return table(spark, d, "events").select("event_id", task.alias("vals")).select("event_id", tuning.parameter(F.col("vals"), "boxRadius").alias("boxRadius"))


@query("hyper_search")
def hyper_search(spark, d):
    """A good trial of five runs with its true loss, and one that can't match it and is stopped early."""
    px = pixels(spark, d)
    sides = sampling.split_sides(px.select("image_id").distinct(), "image_id", 0.2, 5)
    train, test = (px.join(sides.where(F.col("side") == s), "image_id", "left_semi") for s in ("train", "test"))
    base = SMALL.with_(trees=1, horizontal_flipping=False)
    found = tuning.search(train, test, [{"maxDepth": 4, "featureCount": 16}, {"maxDepth": 1, "featureCount": 1, "samplesPerImage": 1}], base, 4)
    return spark.createDataFrame([(r["trial_id"], r["status"], len(r["losses"]), r["loss"], r["true_loss"]) for r in found], "trial_id long, status string, runs int, loss double, true_loss double")


@query("trial_queue", f"SELECT id AS trial_id, 'ok' AS status, round(1 / (round({_unit(3, 'id', chr(39) + 'maxDepth')} * 20 + 5)), 9) AS loss FROM range(6) t(id)")
def trial_queue(spark, d):
    """Trials put into a folder come out with their losses."""
    from canopygrid.streaming import trials

    folder = forest.shared_path(spark, "queue")
    tuning.proposals(spark, 6, 3).select(F.lit("a").alias("exp_key"), "trial_id", F.create_map(F.lit("maxDepth"), F.col("maxDepth")).alias("params")).coalesce(1).write.json(f"{folder}/in")
    trials.watch(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", lambda p: 1 / p["maxDepth"], once=True).awaitTermination()
    return spark.read.schema(trials.RESULT).json(f"{folder}/out").select("trial_id", "status", F.round("loss", 9).alias("loss"))
