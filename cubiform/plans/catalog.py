"""The query catalogue: every operator over the star-schema tables, with the same relation in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalars as S
from ..operators import baselines, canonical, geometry, population, quads, state, verification
from ..operators import difference as D
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIMS = A.DIMS
_KINDS = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN", "d": "DOUBLE"}


def longs(df: DataFrame) -> DataFrame:
    """Every whole number as a long."""
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


def sql(columns: str, body: str, ctes: str = "") -> str:
    """SELECT the named columns, cast to their kinds (whole numbers unless :s, :b or :d), from a body."""
    cast = ", ".join(f"CAST({n} AS {_KINDS[k or 'i']}) AS {n}" for n, _, k in (c.partition(":") for c in columns.split()))
    return f"{'WITH ' + ctes if ctes else ''} SELECT {cast} FROM ({body}) AS result"


def query(name: str, oracle: str | None = None):
    """Registers a query, and its SQL if there is one."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: longs(f(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


# ---- SQL fragments -------------------------------------------------------------------------


def vl(e: str) -> str:
    return f"(1 + CAST(({e}) >= 128 AS INT) + CAST(({e}) >= 16384 AS INT) + CAST(({e}) >= 2097152 AS INT) + CAST(({e}) >= 268435456 AS INT))"


def vh(e: str) -> str:
    byte = lambda x: f"lpad(hex(CAST({x} AS BIGINT)), 2, '0')"
    groups = [f"((({e}) >> {7 * k}) & 127)" for k in range(5)]
    cases = " ".join(f"WHEN ({e}) < {1 << 7 * (n + 1)} THEN " + " || ".join([byte(f"{g} + 128") for g in groups[:n]] + [byte(groups[n])]) for n in range(4))
    return f"lower(CASE {cases} ELSE " + " || ".join([byte(f"{g} + 128") for g in groups[:4]] + [byte(groups[4])]) + " END)"


def root_sql(domain: str, *parts: str) -> str:
    return f"sha256(unhex('{domain.encode().hex()}00' || {' || '.join(parts)}))"


CMDS = f"cmds AS ({A.SQL_COMMANDS})"
_AXIS = lambda along, u, v: (
    f"CASE axis WHEN 0 THEN {along} ELSE {u} END", f"CASE axis WHEN 1 THEN {along} WHEN 0 THEN {u} ELSE {v} END", f"CASE axis WHEN 2 THEN {along} ELSE {v} END"
)


def _b(sub, m, x, y, z, w, h, d, source="cmds", where="") -> str:
    return f"SELECT scene, seq, {sub} AS sub, {m} AS material, {x} AS x, {y} AS y, {z} AS z, {w} AS w, {h} AS h, {d} AS d FROM {source}{' WHERE ' + where if where else ''}"


def _gable_sql(style: str, z_oriented: bool) -> str:
    span, across = ("depth", "width") if z_oriented else ("width", "depth")
    src = f"(SELECT *, unnest(range(0, ({span} + 1) // 2)) AS k FROM cmds) AS t"

    def piece(sub, along, side, n_along, n_side, where=""):
        x, z, w, d = (side, along, n_side, n_along) if z_oriented else (along, side, n_along, n_side)
        return _b(f"k * 4 + {sub}", "material", f"ox + {x}", "oy + k", f"oz + {z}", w, 1, d, src, where)

    far, other = f"({span} - 1 - k)", f"k <> {span} - 1 - k"
    if style == "fill":
        return piece(0, "k", "0", f"{span} - 2 * k", across)
    if style == "outline":
        return piece(0, "k", "0", "1", across) + " UNION ALL " + piece(1, far, "0", "1", across, other)
    return " UNION ALL ".join(piece(2 * i + j, at, side, "1", "1", other if i else "") for i, at in enumerate(("k", far)) for j, side in enumerate(("0", f"({across} - 1)")))


_STEM = "greatest(height - crown, 2)"
_LAYER = "(SELECT *, unnest(range(0, crown)) AS k FROM cmds) AS t"
BOX_SQL = {
    "box": _b(0, "material", "ox", "oy", "oz", "sx", "sy", "sz"),
    "run": _b(0, "material", "ox", "oy", "oz", *(f"CASE axis WHEN {k} THEN length ELSE 1 END" for k in range(3))),
    "wall": _b(0, "material", "ox", "oy", "oz", *_AXIS("thickness", "u", "v")),
    "extrude": _b("k", "material", *(f"{o} + {a}" for o, a in zip(("ox", "oy", "oz"), _AXIS("0", "k % 3", "k // 3"))), *_AXIS("depth", "1", "1"),
                  source="(SELECT *, unnest(range(0, 6)) AS k FROM cmds) AS t", where="(bits >> CAST(k AS INT)) & 1 = 1"),
    "repeat_box": _b("k", "material", "ox + dx * k", "oy + dy * k", "oz + dz * k", "sx", "sy", "sz", source="(SELECT *, unnest(range(0, count)) AS k FROM cmds) AS t"),
    "tree": " UNION ALL ".join([
        _b(0, "material", "ox + 6", "oy", "oz + 6", 2, _STEM, 2),
        _b("1 + 2 * k", "material2", "ox + 6 - greatest(crown - k // 2, 1)", f"oy + {_STEM} - 1 + k", "oz + 5", "greatest(crown - k // 2, 1) * 2 + 2", 1, 4, _LAYER),
        _b("2 + 2 * k", "material2", "ox + 5", f"oy + {_STEM} - 1 + k", "oz + 6 - greatest(crown - k // 2, 1)", 4, 1, "greatest(crown - k // 2, 1) * 2 + 2", _LAYER),
        _b("2 * crown + 1", "material2", "ox + 6", "oy + height - 1", "oz + 6", 2, 1, 2),
    ]),
    "fence": " UNION ALL ".join([
        *(_b(k, "material", "ox", f"oy + {up}", "oz", "CASE axis WHEN 0 THEN length ELSE 1 END", 1, "CASE axis WHEN 1 THEN length ELSE 1 END") for k, up in enumerate((1, 3))),
        _b("k // spacing + 2", "material", "ox + CASE axis WHEN 0 THEN k ELSE 0 END", "oy", "oz + CASE axis WHEN 1 THEN k ELSE 0 END", 1, 5, 1, "(SELECT *, unnest(range(0, length, spacing)) AS k FROM cmds) AS t"),
        _b(geometry.SUBS - 1, "material", "ox + CASE axis WHEN 0 THEN length - 1 ELSE 0 END", "oy", "oz + CASE axis WHEN 1 THEN length - 1 ELSE 0 END", 1, 5, 1),
    ]),
}
BOX_SQL |= {f"gable_{s}_{'z' if o else 'x'}": _gable_sql(s, o) for s in K.GABLE_STYLES for o in (False, True)}


def writes_sql(box_sql: str, name: str = "writes", boxes: str = "boxes") -> str:
    return (
        f"{boxes} AS ({box_sql}), {name} AS (SELECT scene, seq * {geometry.SUBS} + sub AS ord, x + c % w + 32 * (z + c // w % d + 32 * (y + c // (w * d))) AS id, material "
        f"FROM (SELECT *, unnest(range(0, CAST(w * h * d AS BIGINT))) AS c FROM {boxes}) AS cells)"
    )


def state_sql(name: str = "voxels", writes: str = "writes", where: str = "TRUE") -> str:
    return f"{name} AS (SELECT scene, id, arg_max(material, ord) AS material FROM {writes} WHERE {where} GROUP BY scene, id HAVING arg_max(material, ord) <> 0)"


SUMMARY = "SELECT scene, count(*) AS voxels, sum(id) AS id_sum, sum(id * material) AS mat_sum FROM voxels GROUP BY scene"
SUMMARY_COLUMNS = "scene voxels id_sum mat_sum"


def summary(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("scene").agg(F.count(F.lit(1)).alias("voxels"), F.sum("id").alias("id_sum"), F.sum(F.col("id") * F.col("material")).alias("mat_sum"))


def shaped(spark: SparkSession, sf_dir: str, op: str) -> DataFrame:
    """The adapter's commands with what an op needs besides."""
    found = A.commands(spark, sf_dir)
    if op == "extrude":
        return found.withColumn("mask", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.call_function("getbit", F.col("bits"), i).cast("long"))).withColumn("u", F.lit(3).cast("long"))
    if op == "tree":
        return found.withColumn("ox", F.col("ox") + 6).withColumn("oz", F.col("oz") + 6)
    return found


# ---- scalar functions ----------------------------------------------------------------------

_PREFIXES = [(" " if name == K.LEGACY else "") + prefix for prefix, name in K.BEGINNINGS]
_CASES = " ".join(f"WHEN starts_with(t, '{prefix}') THEN '{name}'" for prefix, name in K.BEGINNINGS)
_WHOLE = "SELECT doc_id, CASE " + " ".join(f"WHEN doc_id % {len(_PREFIXES) + 1} = {i} THEN '{t}' || text" for i, t in enumerate(_PREFIXES)) + " ELSE text END AS text FROM documents"


@query("detect_format", sql("doc_id format:s bytes", f"SELECT doc_id, CASE {_CASES} ELSE 'unknown' END AS format, bytes FROM (SELECT doc_id, ltrim(text, chr(9) || chr(10) || chr(12) || chr(13) || ' ') AS t, octet_length(encode(text)) AS bytes FROM texts) AS trimmed", f"texts AS ({_WHOLE})"))
def _(spark, d):
    text = F.col("text")
    for i, t in enumerate(_PREFIXES):
        text = F.when(F.col("doc_id") % (len(_PREFIXES) + 1) == i, F.concat(F.lit(t), F.col("text"))).otherwise(text)
    whole = A.read(spark, d, "documents").select("doc_id", text.alias("text"))
    return whole.select("doc_id", S.detect_format("text").alias("format"), F.octet_length("text").alias("bytes"))


@query("trim_prefix", sql("doc_id trimmed", "SELECT doc_id, length(trim(' ' || text || chr(10), chr(9) || chr(10) || chr(12) || chr(13) || ' ')) AS trimmed FROM documents"))
def _(spark, d):
    return A.read(spark, d, "documents").select("doc_id", F.length(S.trim_ascii(F.concat(F.lit(" "), "text", F.lit("\n")))).alias("trimmed"))


_V = "l_orderkey * 7919 % 300000000 + l_linenumber"


def _values(spark, d, *made):
    return A.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_V).alias("v")).distinct().select("l_orderkey", "l_linenumber", *made)


def _values_sql(columns: str, made: str) -> str:
    return sql(f"l_orderkey l_linenumber {columns}", f"SELECT l_orderkey, l_linenumber, {made} FROM (SELECT DISTINCT l_orderkey, l_linenumber, {_V} AS v FROM lineitem) AS x")


QUERY_VALUES = {
    "varint_len": (lambda: [S.varint_length("v").alias("bytes")], _values_sql("bytes", f"{vl('v')} AS bytes")),
    "varint_hex": (lambda: [S.varint_hex("v").alias("hex")], _values_sql("hex:s", f"{vh('v')} AS hex")),
    "zigzag": (lambda: [S.zigzag(F.col("v") - 150000000).alias("z"), S.unzigzag(S.zigzag(F.col("v") - 150000000)).alias("back")], _values_sql("z back", "CASE WHEN v >= 150000000 THEN 2 * (v - 150000000) ELSE 2 * (150000000 - v) - 1 END AS z, v - 150000000 AS back")),
    "signed_var": (lambda: [S.odd_signed("v").alias("signed")], _values_sql("signed", "CASE WHEN v % 2 = 1 THEN -((v + 1) // 2) ELSE v // 2 END AS signed")),
    "delta10": (lambda: [S.delta_field(F.col("v") % 1000 - 500).alias("field")], _values_sql("field", "CASE WHEN abs(v % 1000 - 500) <= 256 THEN CASE WHEN v % 1000 >= 500 THEN 2 * (v % 1000 - 500) ELSE 2 * (500 - v % 1000) - 1 END END AS field")),
    "bits_needed": (lambda: [S.bits_needed("v").alias("bits")], _values_sql("bits", "length(ltrim(bin(greatest(v, 1)), '0')) AS bits")),
    "saved_bps": (lambda: [S.saved_bps(F.col("v") % 100, F.col("v") % 83).alias("bps")], _values_sql("bps", "CASE WHEN v % 100 = 0 THEN 0 ELSE CAST(trunc(CAST((v % 100 - v % 83) * 10000 AS DOUBLE) / (v % 100)) AS BIGINT) END AS bps")),
}
for _name, (_made, _oracle) in QUERY_VALUES.items():
    query(_name, _oracle)(lambda spark, d, made=_made: _values(spark, d, *made()))


def _coordinates(name: str, first: int, second: int, third: int, names: str, made) -> None:
    a, b, c = names
    size = first * second * third
    oracle = sql(f"l_orderkey l_linenumber i {a} {b} {c} back", f"SELECT l_orderkey, l_linenumber, i, i % {first} AS {a}, i // {first} % {second} AS {b}, i // {first * second} AS {c}, i AS back FROM "
                 f"(SELECT DISTINCT l_orderkey, l_linenumber, ({_V}) % {size} AS i FROM lineitem) AS x")  # fmt: skip

    @query(f"coord_roundtrip_{name}", oracle)
    def _(spark, d):
        i = F.col("v") % size
        parts = S.split_id(i, first, second)
        at = dict(zip(names, parts))
        return _values(spark, d, i.alias("i"), *(at[n].alias(n) for n in names), made(at["x"], at["y"], at["z"]).alias("back"))


_coordinates("building", 32, 32, 32, "xzy", lambda x, y, z: S.building_id(x, y, z, F.lit(32), F.lit(32)))
_coordinates("terrain", 16, 16, 512, "xzy", S.terrain_id)
_coordinates("forge", 14, 10, 14, "xyz", S.forge_id)


@query("base64_canonical", sql("doc_id url:s bytes", """SELECT doc_id, replace(replace(rtrim(base64(encode(text)), '='), '+', '-'), '/', '_') AS url, octet_length(encode(text)) AS bytes FROM documents"""))
def _(spark, d):
    url = S.base64url(F.encode("text", "UTF-8"))
    return A.read(spark, d, "documents").select("doc_id", url.alias("url"), F.octet_length(S.unbase64url(url)).alias("bytes"))


@query("sha_domain", sql("doc_id hash:s", f"SELECT doc_id, {root_sql(K.ENCODING_DOMAIN, repr('0202'), 'hex(encode(text))')} AS hash FROM documents"))
def _(spark, d):
    return A.read(spark, d, "documents").select("doc_id", S.encoding_hash("building", K.LEGACY, F.hex(F.encode("text", "UTF-8"))).alias("hash"))


@query("field_widths", sql("p_partkey width", "SELECT p_partkey, length(ltrim(bin(greatest(p_size - 1, 1)), '0')) AS width FROM part"))
def _(spark, d):
    return A.read(spark, d, "part").select("p_partkey", S.bits_needed(F.col("p_size") - 1).alias("width"))


# ---- generators ----------------------------------------------------------------------------


def _raster(name: str, op: str) -> None:
    @query(name, sql(SUMMARY_COLUMNS, SUMMARY, ", ".join([CMDS, writes_sql(BOX_SQL[op]), state_sql()])))
    def _(spark, d):
        return summary(geometry.voxels(shaped(spark, d, op), DIMS, op))


for _op in BOX_SQL:
    _raster("raster_repeat" if _op == "repeat_box" else f"raster_{_op}", _op)

_CELL = "(l_partkey * 97 + l_suppkey) % 32768"


@query("literal", sql(SUMMARY_COLUMNS, SUMMARY, f"voxels AS (SELECT l_orderkey AS scene, CAST({_CELL} AS BIGINT) AS id, max(l_linenumber) AS material FROM lineitem GROUP BY ALL)"))
def _(spark, d):
    rows = A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("scene"), F.expr(_CELL).alias("id"), F.col("l_linenumber").cast("long").alias("material"))
    return summary(rows.groupBy("scene", "id").agg(F.max("material").alias("material")))


TERRAIN = f"terrain AS ({A.SQL_TERRAIN})"
_DELETED = "SELECT scene, count(*) AS cells, sum(id) AS id_sum FROM deleted GROUP BY scene"


def deleted(rows: DataFrame) -> DataFrame:
    return rows.select("scene", "id").distinct().groupBy("scene").agg(F.count(F.lit(1)).alias("cells"), F.sum("id").alias("id_sum"))


@query("delete_run", sql("scene cells id_sum", _DELETED, f"{TERRAIN}, deleted AS (SELECT DISTINCT scene, unnest(range(id, least(id + 1 + seq % 9, 131072))) AS id FROM terrain)"))
def _(spark, d):
    runs = A.terrain(spark, d).repartition("scene")
    end = F.least(F.col("id") + 1 + F.col("seq") % 9, F.lit(131072))
    return deleted(runs.select("scene", F.explode(F.sequence(F.col("id"), end - 1)).alias("id")))


@query("delete_box", sql("scene cells id_sum", _DELETED, f"""{TERRAIN}, deleted AS (SELECT DISTINCT scene, x + c % w + 16 * (z + c // w % e + 16 * (y + c // (w * e))) AS id FROM (SELECT *, unnest(range(0, w * h * e)) AS c FROM
 (SELECT scene, id % 12 AS x, id // 16 % 12 AS z, id // 256 % 500 AS y, 1 + seq % 4 AS w, 1 + seq % 3 AS h, 1 + seq % 2 AS e FROM terrain) AS b) AS t)"""))  # fmt: skip
def _(spark, d):
    at = A.terrain(spark, d).repartition("scene").selectExpr("scene", "seq", "0L AS sub", "1L AS material", "id % 12 AS x", "id div 256 % 500 AS y", "id div 16 % 12 AS z", "1 + seq % 4 AS w", "1 + seq % 3 AS h", "1 + seq % 2 AS d")
    return deleted(geometry.cells(at, K.TERRAIN_GRID))


@query("layer_bitmap", sql("scene y bits ids", "SELECT scene, id // 256 AS y, count(DISTINCT id) AS bits, sum(DISTINCT id % 256) AS ids FROM terrain GROUP BY scene, id // 256", TERRAIN))
def _(spark, d):
    return A.terrain(spark, d).select("scene", "id").distinct().groupBy("scene", F.expr("id div 256").alias("y")).agg(F.count(F.lit(1)).alias("bits"), F.sum(F.col("id") % 256).alias("ids"))


@query("elias_fano_size", sql("scene n low high", "SELECT scene, n, CAST(floor(log2(131072.0 / n)) AS BIGINT) AS low, (131071 >> CAST(floor(log2(131072.0 / n)) AS INT)) + n + 1 AS high FROM (SELECT scene, count(DISTINCT id) AS n FROM terrain GROUP BY scene) AS t", TERRAIN))
def _(spark, d):
    n = A.terrain(spark, d).groupBy("scene").agg(F.count_distinct("id").alias("n"))
    low = F.floor(F.log2(F.lit(131072.0) / F.col("n")))
    return n.select("scene", "n", low.alias("low"), (F.call_function("shiftright", F.lit(131071), low.cast("int")) + F.col("n") + 1).alias("high"))


@query("elias_fano_bits", sql("scene n low_sum high_sum", """SELECT scene, max(n) AS n, sum(id & ((1 << l) - 1)) AS low_sum, sum((id >> l) + r - 1) AS high_sum FROM (SELECT scene, id, r, n, CAST(floor(log2(131072.0 / n)) AS INT) AS l
 FROM (SELECT scene, id, row_number() OVER (PARTITION BY scene ORDER BY id) AS r, count(*) OVER (PARTITION BY scene) AS n FROM (SELECT DISTINCT scene, id FROM terrain) AS u) AS v) AS w GROUP BY scene""", TERRAIN))  # fmt: skip
def _(spark, d):
    w = Window.partitionBy("scene")
    rows = A.terrain(spark, d).select("scene", "id").distinct().select("scene", "id", F.row_number().over(w.orderBy("id")).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    rows = rows.withColumn("l", F.floor(F.log2(F.lit(131072.0) / F.col("n"))).cast("int"))
    return rows.groupBy("scene").agg(F.max("n").alias("n"), F.sum(F.expr("id & (shiftleft(1L, l) - 1)")).alias("low_sum"), F.sum(F.expr("shiftright(id, l) + r - 1")).alias("high_sum"))


FORGE = f"forge AS ({A.SQL_FORGE})"


@query("forge_solid", sql("component cells id_sum", "SELECT component, count(*) AS cells, sum(cell) AS id_sum FROM (SELECT DISTINCT component, unnest(range(0, 1960)) AS cell FROM forge) AS t GROUP BY component", FORGE))
def _(spark, d):
    every = A.forge(spark, d).select("component").distinct().select("component", F.explode(F.sequence(F.lit(0), F.lit(1959))).alias("cell"))
    return every.groupBy("component").agg(F.count(F.lit(1)).alias("cells"), F.sum("cell").alias("id_sum"))


@query("forge_sparse", sql("component cells gap_sum", """SELECT component, count(*) AS cells, sum(coalesce(cell - before - 1, cell)) AS gap_sum FROM (SELECT component, cell, lag(cell) OVER (PARTITION BY component ORDER BY cell) AS before
 FROM (SELECT DISTINCT component, cell FROM forge) AS u) AS t GROUP BY component""", FORGE))  # fmt: skip
def _(spark, d):
    rows = canonical.gaps(A.forge(spark, d).select("component", "cell").distinct(), "component", "cell")
    return rows.groupBy("component").agg(F.count(F.lit(1)).alias("cells"), F.sum("gap").alias("gap_sum"))


@query("forge_rle", sql("component runs bytes", f"""SELECT component, 2 * count(*) AS runs, sum({vl('length')} + {vl('before')}) AS bytes FROM (SELECT component, length, start - coalesce(lag(start + length) OVER (PARTITION BY component ORDER BY start), 0) AS before
 FROM (SELECT component, min(cell) AS start, count(*) AS length FROM (SELECT component, cell, cell - row_number() OVER (PARTITION BY component ORDER BY cell) AS island FROM (SELECT DISTINCT component, cell FROM forge) AS u) AS i GROUP BY component, island) AS r) AS t GROUP BY component""", FORGE))  # fmt: skip
def _(spark, d):
    rows = A.forge(spark, d).select("component", F.col("cell").alias("id")).distinct()
    runs = D.islands(rows, ["component"])
    before = F.col("start") - F.coalesce(F.lag(F.col("start") + F.col("length")).over(Window.partitionBy("component").orderBy("start")), F.lit(0))
    return runs.withColumn("before", before).groupBy("component").agg((2 * F.count(F.lit(1))).alias("runs"), F.sum(S.varint_length("length") + S.varint_length("before")).alias("bytes"))


# ---- clears and transforms -----------------------------------------------------------------

_CUTS = f"SELECT scene, ord, id, CASE WHEN flag = 'R' THEN 0 ELSE material END AS material FROM writes JOIN (SELECT scene AS s, seq, flag FROM cmds) AS f ON s = scene AND seq = ord // {geometry.SUBS}"
LAID = ", ".join([CMDS, writes_sql(BOX_SQL["box"]), f"laid AS ({_CUTS})"])


def laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of all commands; those of returned lines cut."""
    commands = A.commands(spark, sf_dir).repartition("scene").withColumn("material", F.when(F.col("flag") == "R", 0).otherwise(F.col("material")))
    return geometry.cells(geometry.boxes(commands, "box"), DIMS)


@query("cut", sql(SUMMARY_COLUMNS, SUMMARY, f"{LAID}, {state_sql('voxels', 'laid')}"))
def _(spark, d):
    return summary(state.last_writer(laid(spark, d)))


@query("lww_state", sql("scene id material", "SELECT * FROM voxels", f"{LAID}, {state_sql('voxels', 'laid')}"))
def _(spark, d):
    return state.last_writer(laid(spark, d))


_AT_CLEAR = f"SELECT scene, max(ord) AS clear_at FROM laid WHERE material = 0 GROUP BY scene"


@query("clear_box_removed", sql("scene seq removed", f"""SELECT l.scene, l.ord // {geometry.SUBS} AS seq, count(*) AS removed FROM laid AS l JOIN (SELECT scene AS s, id AS i, ord AS o, arg_max(m2, o2) AS held FROM
 (SELECT a.scene, a.id, a.ord, b.ord AS o2, b.material AS m2 FROM laid AS a JOIN laid AS b ON a.scene = b.scene AND a.id = b.id AND b.ord < a.ord WHERE a.material = 0) AS p GROUP BY ALL) AS h
 ON s = l.scene AND i = l.id AND o = l.ord WHERE l.material = 0 AND held <> 0 GROUP BY ALL""", LAID))  # fmt: skip
def _(spark, d):
    before = F.lag("material").over(Window.partitionBy("scene", "id").orderBy("ord"))
    hit = laid(spark, d).withColumn("held", before).filter("material = 0 AND held <> 0")
    return hit.groupBy("scene", F.expr(f"ord div {geometry.SUBS}").alias("seq")).agg(F.count(F.lit(1)).alias("removed"))


_HOLES = "holes AS (SELECT DISTINCT component, component % 10 AS ox, component % 7 AS oy, component % 11 AS oz, 1 + component % 4 AS sx, 1 + component % 3 AS sy, 1 + component % 3 AS sz FROM forge)"


@query("cut_box", sql("component cells id_sum", """SELECT component, count(*) AS cells, sum(cell) AS id_sum FROM (SELECT DISTINCT f.component, cell FROM forge AS f JOIN holes USING (component)
 WHERE NOT (cell % 14 >= ox AND cell % 14 < ox + sx AND cell // 14 % 10 >= oy AND cell // 14 % 10 < oy + sy AND cell // 140 >= oz AND cell // 140 < oz + sz)) AS t GROUP BY component""", f"{FORGE}, {_HOLES}"))  # fmt: skip
def _(spark, d):
    cells, c = A.forge(spark, d), "component"
    holes = cells.select(c).distinct().selectExpr(c, f"{c} % 10 AS ox", f"{c} % 7 AS oy", f"{c} % 11 AS oz", f"1 + {c} % 4 AS sx", f"1 + {c} % 3 AS sy", f"1 + {c} % 3 AS sz")
    return state.cut_boxes(cells, holes, K.FORGE_GRID).groupBy(c).agg(F.count(F.lit(1)).alias("cells"), F.sum("cell").alias("id_sum"))


for _axis, _image in enumerate(("cell + 13 - 2 * (cell % 14)", "cell + 14 * (9 - 2 * (cell // 14 % 10))", "cell + 140 * (13 - 2 * (cell // 140))")):

    @query(f"symmetry_{'xyz'[_axis]}", sql("component cells id_sum", f"SELECT component, count(*) AS cells, sum(cell) AS id_sum FROM (SELECT component, cell FROM forge UNION SELECT component, {_image} FROM forge) AS t GROUP BY component", FORGE))
    def _(spark, d, axis=_axis):
        return state.symmetry(A.forge(spark, d), axis, K.FORGE_GRID).groupBy("component").agg(F.count(F.lit(1)).alias("cells"), F.sum("cell").alias("id_sum"))


#: One transform a scene, after all commands: arguments from its first command.
_T = "t AS (SELECT scene, 1000 AS seq, ox, oy, oz, 8 AS sx, 6 AS sy, 9 AS sz, axis, dx + 3 AS dx, dy + 1 AS dy, dz + 3 AS dz, count, {turns} AS turns, 12 AS px, oy AS py, 14 AS pz, 2 * ox + 9 AS pivot_twice FROM cmds WHERE seq = 1)"
_IN = "v.id % 32 BETWEEN t.ox AND t.ox + 7 AND v.id // 1024 BETWEEN t.oy AND t.oy + 5 AND v.id // 32 % 32 BETWEEN t.oz AND t.oz + 8"


def _transform_sql(x: str, y: str, z: str, turns: int = 1, more: str = "") -> str:
    region = f"region AS (SELECT v.scene, v.material, t.*EXCLUDE (scene), v.id % 32 - ox AS rx, v.id // 1024 - oy AS ry, v.id // 32 % 32 - oz AS rz{more} FROM base AS v JOIN t ON v.scene = t.scene WHERE {_IN})"
    moved = f"moved AS (SELECT scene, {'k' if more else 0} AS ord, {x} + 32 * ({z} + 32 * ({y})) AS id, material FROM region UNION ALL SELECT scene, -1, id, material FROM base)"
    return sql(SUMMARY_COLUMNS, SUMMARY, ", ".join([CMDS, writes_sql(BOX_SQL["box"]), state_sql("base"), _T.format(turns=turns), region, moved, state_sql("voxels", "moved")]))


def _transform(name: str, op: str, oracle: str, turns: int = 1, **how) -> None:
    @query(name, oracle)
    def _(spark, d):
        commands = A.commands(spark, d)
        base = state.last_writer(geometry.draw(commands, DIMS, "box"))
        t = commands.filter("seq = 1").selectExpr(
            "scene", "1000L AS seq", "ox", "oy", "oz", "8L AS sx", "6L AS sy", "9L AS sz", "axis", "dx + 3 AS dx", "dy + 1 AS dy", "dz + 3 AS dz", "count", f"{turns}L AS turns", "12L AS px", "oy AS py", "14L AS pz", "2 * ox + 9 AS pivot_twice"
        )
        return summary(state.transformed(base, t, op, DIMS, **how))


_transform("translate", "translate", _transform_sql("ox + rx + dx", "oy + ry + dy", "oz + rz + dz"))
for _n, (_x, _z) in {1: ("px + sz - 1 - rz", "pz + rx"), 2: ("px + sx - 1 - rx", "pz + sz - 1 - rz"), 3: ("px + rz", "pz + sx - 1 - rx")}.items():
    _transform(f"rotate_y_{_n}", "rotate_y", _transform_sql(_x, "py + ry", _z, _n), _n)
_MIRROR = [f"p{c} + CASE WHEN axis = {k} THEN s{c} - 1 - r{c} ELSE r{c} END" for k, c in enumerate("xyz")]
_transform("mirror_dest", "mirror", _transform_sql(*_MIRROR))
_PIVOT = [f"CASE WHEN axis = {k} THEN {'pivot_twice'} - o{c} - r{c} ELSE o{c} + r{c} END" for k, c in enumerate("xyz")]
_transform("mirror_pivot", "mirror", _transform_sql(*_PIVOT), pivot=True)
_transform("repeat_region", "repeat_region", _transform_sql("ox + rx + dx * k", "oy + ry + dy * k", "oz + rz + dz * k", 1, ", unnest(range(1, count)) AS k"))


@query("region_snapshot", sql("scene cells", f"SELECT v.scene, count(*) AS cells FROM base AS v JOIN t ON v.scene = t.scene WHERE {_IN} GROUP BY v.scene", ", ".join([CMDS, writes_sql(BOX_SQL["box"]), state_sql("base"), _T.format(turns=1)])))
def _(spark, d):
    commands = A.commands(spark, d)
    t = commands.filter("seq = 1").selectExpr("scene", "ox", "oy", "oz", "8L AS sx", "6L AS sy", "9L AS sz")
    return state.region(state.last_writer(geometry.draw(commands, DIMS, "box")), t, DIMS).groupBy("scene").agg(F.count(F.lit(1)).alias("cells"))


# ---- limits --------------------------------------------------------------------------------

BOXES = f"{CMDS}, boxes AS ({BOX_SQL['repeat_box']})"


def _repeats(spark, d):
    return geometry.boxes(A.commands(spark, d), "repeat_box")


@query("write_accounting", sql("scene commands writes", "SELECT scene, count(DISTINCT seq) AS commands, sum(w * h * d) AS writes FROM boxes GROUP BY scene", BOXES))
def _(spark, d):
    return state.accounting(_repeats(spark, d))


@query("expansion_violations", sql("scene seq cells", "SELECT scene, seq, sum(w * h * d) AS cells FROM boxes GROUP BY scene, seq HAVING sum(w * h * d) > 60", BOXES))
def _(spark, d):
    return geometry.volume(_repeats(spark, d)).groupBy("scene", "seq").agg(F.sum("cells").alias("cells")).filter("cells > 60")


@query("running_budget", sql("scene first_over", "SELECT scene, min(seq) AS first_over FROM (SELECT scene, seq, sum(n) OVER (PARTITION BY scene ORDER BY seq) AS used FROM (SELECT scene, seq, sum(w * h * d) AS n FROM boxes GROUP BY ALL) AS t) AS u WHERE used > 150 GROUP BY scene", BOXES))
def _(spark, d):
    each = geometry.volume(_repeats(spark, d)).groupBy("scene", "seq").agg(F.sum("cells").alias("n"))
    used = each.withColumn("used", F.sum("n").over(Window.partitionBy("scene").orderBy("seq")))
    return used.filter("used > 150").groupBy("scene").agg(F.min("seq").alias("first_over"))


_DRAWN = ", ".join([CMDS, writes_sql(BOX_SQL["box"]), state_sql()])


def _drawn(spark, d):
    return state.last_writer(geometry.draw(A.commands(spark, d), DIMS, "box"))


@query("voxel_limit", sql("scene voxels over_limit:b", "SELECT scene, count(*) AS voxels, count(*) > 100 AS over_limit FROM voxels GROUP BY scene", _DRAWN))
def _(spark, d):
    return _drawn(spark, d).groupBy("scene").agg(F.count(F.lit(1)).alias("voxels")).withColumn("over_limit", F.col("voxels") > 100)


@query("distinct_materials", sql("scene materials", "SELECT scene, count(DISTINCT material) AS materials FROM voxels GROUP BY scene", _DRAWN))
def _(spark, d):
    return _drawn(spark, d).groupBy("scene").agg(F.count_distinct("material").alias("materials"))


@query("order_violations", sql("scene violations", "SELECT scene, count(*) AS violations FROM (SELECT scene, id, lag(id) OVER (PARTITION BY scene ORDER BY seq) AS before FROM terrain) AS t WHERE before >= id GROUP BY scene", TERRAIN))
def _(spark, d):
    rows = A.terrain(spark, d).withColumn("before", F.lag("id").over(Window.partitionBy("scene").orderBy("seq")))
    return rows.filter("before >= id").groupBy("scene").agg(F.count(F.lit(1)).alias("violations"))


# ---- differences ---------------------------------------------------------------------------

#: Target: all writes, cuts included; base: those of the first three commands.
_PAIRS = f"{LAID}, {state_sql('want', 'laid')}, {state_sql('have', 'laid', f'ord < {4 * geometry.SUBS}')}"
PAIRS = f"{_PAIRS}, pairs AS (SELECT coalesce(w.scene, h.scene) AS scene, coalesce(w.id, h.id) AS id, w.material AS want, h.material AS have FROM want AS w FULL JOIN have AS h ON w.scene = h.scene AND w.id = h.id)"
PATCHES = f"{PAIRS}, patches AS (SELECT scene, id, CASE WHEN have IS NULL THEN 0 WHEN want IS NULL THEN 1 ELSE 2 END AS kind, coalesce(want, 0) AS material FROM pairs WHERE want IS DISTINCT FROM have)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and base in one aggregation over the writes: no cell is shuffled."""
    early = F.when(F.col("ord") < 4 * geometry.SUBS, F.col("ord"))
    both = laid(spark, sf_dir).groupBy("scene", "id").agg(F.max_by("material", "ord").alias("want"), F.max_by("material", early).alias("have"))
    clean = lambda c: F.when(F.col(c) != 0, F.col(c))
    return both.select("scene", "id", clean("want").alias("want"), clean("have").alias("have")).filter("want is not null or have is not null")


@query("mismatch_building", sql("scene mismatches", "SELECT scene, count(*) FILTER (want IS DISTINCT FROM have) AS mismatches FROM pairs GROUP BY scene", PAIRS))
def _(spark, d):
    target = state.last_writer(laid(spark, d))
    base = state.as_of(laid(spark, d), F.lit(4 * geometry.SUBS))
    return D.mismatches(D.compared(target, base))


@query("mismatch_terrain", sql("scene mismatches", "SELECT scene, count(*) AS mismatches FROM (SELECT scene, id FROM terrain GROUP BY ALL HAVING (count(*) FILTER (seq % 3 > 0) > 0) <> (count(*) FILTER (seq % 2 > 0) > 0)) AS t GROUP BY scene", TERRAIN))
def _(spark, d):
    rows = A.terrain(spark, d).groupBy("scene", "id").agg((F.count_if(F.col("seq") % 3 > 0) > 0).alias("a"), (F.count_if(F.col("seq") % 2 > 0) > 0).alias("b"))
    return rows.filter("a <> b").groupBy("scene").agg(F.count(F.lit(1)).alias("mismatches"))


@query("mismatch_forge", sql("component mismatches", "SELECT component, count(*) AS mismatches FROM (SELECT component, cell FROM forge GROUP BY ALL HAVING (count(*) FILTER (seq % 3 > 0) > 0) <> (count(*) FILTER (seq % 2 > 0) > 0)) AS t GROUP BY component", FORGE))
def _(spark, d):
    rows = A.forge(spark, d).groupBy("component", "cell").agg((F.count_if(F.col("seq") % 3 > 0) > 0).alias("a"), (F.count_if(F.col("seq") % 2 > 0) > 0).alias("b"))
    return rows.filter("a <> b").groupBy("component").agg(F.count(F.lit(1)).alias("mismatches"))


@query("patches", sql("scene kind patches id_sum mat_sum", "SELECT scene, kind, count(*) AS patches, sum(id) AS id_sum, sum(id * material) AS mat_sum FROM patches GROUP BY scene, kind", PATCHES))
def _(spark, d):
    return D.patches(pairs(spark, d)).groupBy("scene", "kind").agg(F.count(F.lit(1)).alias("patches"), F.sum("id").alias("id_sum"), F.sum(F.col("id") * F.col("material")).alias("mat_sum"))


_ISLE = "SELECT {keys}, min(id) AS start, count(*) AS length FROM (SELECT *, id - row_number() OVER (PARTITION BY {keys} ORDER BY id) AS island FROM {rows}) AS t GROUP BY {keys}, island"
RUNS = _ISLE.format(keys="scene, kind, material", rows="patches")
ROWS = _ISLE.format(keys="scene, kind, material, line", rows="(SELECT *, id // 32 AS line FROM patches) AS p")
LAYERS = "SELECT scene, id // 1024 AS y, kind, material, count(*) AS bits, sum(id % 1024) AS place_sum FROM patches GROUP BY ALL"


@query("patch_runs", sql("scene kind material start length", RUNS, PATCHES))
def _(spark, d):
    return D.patch_runs(D.patches(pairs(spark, d)))


@query("patch_boxes", sql("scene kind material start length", ROWS, PATCHES))
def _(spark, d):
    return D.patch_boxes(D.patches(pairs(spark, d)), 32)


@query("patch_layers", sql("scene y kind material bits place_sum", LAYERS, PATCHES))
def _(spark, d):
    return D.patch_layers(D.patches(pairs(spark, d)), 32, 32).withColumn("place_sum", F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + x)).drop("places")


@query("patch_groups", sql("scene kind material n ids:s", "SELECT scene, kind, material, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM patches GROUP BY scene, kind, material", PATCHES))
def _(spark, d):
    return D.patch_groups(D.patches(pairs(spark, d))).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


_INDEXED = (
    f"{PATCHES}, palette AS (SELECT scene, material, row_number() OVER (PARTITION BY scene ORDER BY material) - 1 AS index FROM (SELECT scene, want AS material FROM pairs WHERE want IS NOT NULL UNION SELECT scene, have FROM pairs WHERE have IS NOT NULL) AS m), "
    f"p AS (SELECT a.*, coalesce(index, 0) AS index, 1 + CASE WHEN kind = 1 THEN 0 ELSE {vl('coalesce(index, 0)')} END AS act FROM patches AS a LEFT JOIN palette AS q ON a.scene = q.scene AND a.material = q.material)"
)
_P_ISLE = lambda keys, rows: f"SELECT {keys}, any_value(act) AS act, min(id) AS start, count(*) AS length FROM (SELECT *, id - row_number() OVER (PARTITION BY {keys} ORDER BY id) AS island FROM {rows}) AS t GROUP BY {keys}, island"
COSTS = f"""{_INDEXED},
 c1 AS (SELECT scene, count(*) AS patches, 1 + {vl('count(*)')} + sum({vl('coalesce(id - b - 1, id)')} + act) AS sparse FROM (SELECT *, lag(id) OVER (PARTITION BY scene ORDER BY id) AS b FROM p) AS t GROUP BY scene),
 c2 AS (SELECT scene, 1 + {vl('count(*)')} + sum({vl('coalesce(start - e, start)')} + {vl('length - 1')} + act) AS runs FROM (SELECT *, lag(start + length) OVER (PARTITION BY scene ORDER BY start) AS e FROM ({_P_ISLE('scene, kind, material', 'p')}) AS r) AS t GROUP BY scene),
 c3 AS (SELECT scene, 1 + {vl('count(*)')} + sum({vl('start % 32')} + {vl('start // 1024')} + {vl('start // 32 % 32')} + {vl('length - 1')} + 2 + act) AS boxes FROM ({_P_ISLE('scene, kind, material, line', '(SELECT *, id // 32 AS line FROM p) AS q')}) AS t GROUP BY scene),
 c4 AS (SELECT scene, 1 + {vl('count(*)')} + sum({vl('y')} + act + 128) AS layers FROM (SELECT scene, id // 1024 AS y, kind, material, any_value(act) AS act FROM p GROUP BY ALL) AS t GROUP BY scene),
 c5 AS (SELECT scene, 1 + 4096 + sum(act) AS xor FROM p GROUP BY scene),
 c6 AS (SELECT scene, 1 + {vl('count(*)')} + sum(act + {vl('n')} + g) AS groups FROM (SELECT scene, kind, material, any_value(act) AS act, count(*) AS n, sum({vl('coalesce(id - b - 1, id)')}) AS g FROM (SELECT *, lag(id) OVER (PARTITION BY scene, kind, material ORDER BY id) AS b FROM p) AS t GROUP BY scene, kind, material) AS u GROUP BY scene),
 costs AS (SELECT * FROM c1 JOIN c2 USING (scene) JOIN c3 USING (scene) JOIN c4 USING (scene) JOIN c5 USING (scene) JOIN c6 USING (scene))"""


def indexed(found: DataFrame) -> DataFrame:
    """Patches with their place in the palette of both scenes, still dealt by scene."""
    whole = Window.partitionBy("scene")
    both = F.array_sort(F.array_union(F.collect_set("want").over(whole), F.collect_set("have").over(whole)))
    listed = found.withColumn("palette", both)
    kind = F.when(F.col("have").isNull(), D.SET).when(F.col("want").isNull(), D.CLEAR).otherwise(D.PAINT)
    rows = listed.filter(~F.col("want").eqNullSafe(F.col("have"))).select("scene", "id", kind.alias("kind"), F.coalesce("want", F.lit(0)).alias("material"), "palette")
    return rows.withColumn("index", F.greatest(F.array_position("palette", F.col("material")) - 1, F.lit(0))).drop("palette")


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.residual_costs(indexed(pairs(spark, sf_dir)), *DIMS)


@query("residual_costs", sql("scene patches sparse runs boxes layers xor groups", "SELECT * FROM costs", COSTS))
def _(spark, d):
    return costs(spark, d)


@query("residual_best", sql("scene patches codec:s bytes", """SELECT scene, patches, CASE least(sparse * 8 + 1, runs * 8 + 2, boxes * 8 + 3, layers * 8 + 4, xor * 8 + 5, groups * 8 + 6) % 8 WHEN 1 THEN 'sparse' WHEN 2 THEN 'runs' WHEN 3 THEN 'boxes' WHEN 4 THEN 'layers' WHEN 5 THEN 'xor' ELSE 'groups' END AS codec,
 least(sparse, runs, boxes, layers, xor, groups) AS bytes FROM costs""", COSTS))  # fmt: skip
def residual_best(spark, d):
    return D.best_codec(costs(spark, d))


@query("apply_patches", sql(SUMMARY_COLUMNS, SUMMARY, f"{_PAIRS}, voxels AS (SELECT * FROM want)"))
def _(spark, d):
    base = state.as_of(laid(spark, d), F.lit(4 * geometry.SUBS))
    return summary(D.apply_patches(base, D.patches(pairs(spark, d))))


@query("noop_patch_violations", sql("scene kind n", """SELECT p.scene, p.kind, count(*) AS n FROM patches AS p LEFT JOIN want AS w ON p.scene = w.scene AND p.id = w.id
 WHERE (kind = 0 AND w.material IS NOT NULL) OR (kind = 1 AND w.material IS NULL) OR (kind = 2 AND (w.material IS NULL OR w.material = p.material)) GROUP BY ALL""", PATCHES))  # fmt: skip
def _(spark, d):
    return D.patch_violations(state.last_writer(laid(spark, d)), D.patches(pairs(spark, d))).groupBy("scene", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("prefilter_stats", sql("scene mismatches sets paints runs", f"SELECT scene, m AS mismatches, sets, paints, runs FROM (SELECT scene, count(*) AS m, count(*) FILTER (kind = 0) AS sets, count(*) FILTER (kind = 2) AS paints FROM patches GROUP BY scene) AS a JOIN (SELECT scene, count(*) AS runs FROM ({RUNS}) AS r GROUP BY scene) AS b USING (scene)", PATCHES))
def _(spark, d):
    return D.prefilter_stats(pairs(spark, d))


@query("palette_index", sql("scene material index", "SELECT scene, material, dense_rank() OVER (PARTITION BY scene ORDER BY material) - 1 AS index FROM (SELECT DISTINCT scene, material FROM voxels) AS t", _DRAWN))
def _(spark, d):
    rows = _drawn(spark, d).select("scene", "material").distinct()
    return rows.withColumn("index", F.row_number().over(Window.partitionBy("scene").orderBy("material")) - 1)


# ---- canonical forms -----------------------------------------------------------------------

_GAPS = "(SELECT *, coalesce(id - lag(id) OVER (PARTITION BY scene ORDER BY id) - 1, id) AS gap FROM voxels) AS g"


@query("gap_code", sql("scene bytes", f"SELECT scene, sum({vl('gap')}) AS bytes FROM {_GAPS} GROUP BY scene", _DRAWN))
def _(spark, d):
    return canonical.gaps(_drawn(spark, d)).groupBy("scene").agg(F.sum(S.varint_length("gap")).alias("bytes"))


_BUILDING = f"""SELECT scene, n AS voxels, {root_sql(K.SEMANTIC_DOMAIN, "'02'", "'202020'", vh('n'), 'body')} AS root FROM (SELECT scene, count(*) AS n, string_agg({vh('gap')} || {vh('material')}, '' ORDER BY id) AS body FROM {_GAPS} GROUP BY scene) AS t"""


@query("semantic_root_building", sql("scene voxels root:s", _BUILDING, _DRAWN))
def _(spark, d):
    return canonical.building_roots(_drawn(spark, d), DIMS)


@query("semantic_root_terrain", sql("scene deletions root:s", f"""SELECT scene, n AS deletions, {root_sql(K.SEMANTIC_DOMAIN, "'01'", vh('zz'), vh('n'), 'body')} AS root FROM (SELECT scene, CASE WHEN any_value(min_y) >= 0 THEN 2 * any_value(min_y) ELSE -2 * any_value(min_y) - 1 END AS zz, count(*) AS n,
 string_agg({vh('gap')}, '' ORDER BY id) AS body FROM (SELECT *, coalesce(id - lag(id) OVER (PARTITION BY scene ORDER BY id) - 1, id) AS gap FROM (SELECT DISTINCT scene, id, min_y FROM terrain) AS u) AS g GROUP BY scene) AS t""", TERRAIN))  # fmt: skip
def _(spark, d):
    return canonical.terrain_roots(A.terrain(spark, d))


@query("semantic_root_forge", sql("component cells root:s", f"""SELECT component, n AS cells, {root_sql(K.SEMANTIC_DOMAIN, "'03'", vh('n'), 'body')} AS root FROM (SELECT component, count(*) AS n, string_agg({vh('gap')}, '' ORDER BY cell) AS body FROM
 (SELECT *, coalesce(cell - lag(cell) OVER (PARTITION BY component ORDER BY cell) - 1, cell) AS gap FROM (SELECT DISTINCT component, cell FROM forge) AS u) AS g GROUP BY component) AS t""", FORGE))  # fmt: skip
def _(spark, d):
    return canonical.forge_cell_hex(A.forge(spark, d)).select("component", "cells", S.semantic_root("forged_item", "body").alias("root"))


@query("encoding_hash", sql("page_id bytes hash:s", f"SELECT page_id, octet_length(encode(html)) AS bytes, {root_sql(K.ENCODING_DOMAIN, repr('0205'), 'hex(encode(html))')} AS hash FROM pages"))
def _(spark, d):
    return A.read(spark, d, "pages").select("page_id", F.octet_length("html").alias("bytes"), S.encoding_hash("building", K.COMPACT, F.hex(F.encode("html", "UTF-8"))).alias("hash"))


_BITS = {
    "box": "4 + m + 30", "repeat_box": "4 + m + 69", "gable": "4 + m + 28", "tree": "4 + 2 * m + 25", "fence": "4 + m + 27", "run": "4 + m + 22", "wall": "4 + m + 32",
    "extrude": "4 + m + 38", "translate": "64", "rotate_y": "51", "mirror": "51", "repeat_region": "73", "clear_box": "34",
}
_OPS = "CASE (seq - 1) % 13 " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(K.OPCODES)) + " END"
BITS = f"{CMDS}, bits AS (SELECT scene, seq, CASE op " + " ".join(f"WHEN '{o}' THEN {b}" for o, b in _BITS.items()) + f" END AS bits, ms FROM (SELECT scene, seq, {_OPS} AS op, ms, length(ltrim(bin(greatest(ms - 1, 1)), '0')) AS m FROM cmds JOIN (SELECT scene, count(DISTINCT material) AS ms FROM cmds GROUP BY scene) AS q USING (scene)) AS t)"


def _bits(spark, d):
    commands = A.commands(spark, d)
    whole = Window.partitionBy("scene")
    op = F.element_at(F.array(*map(F.lit, K.OPCODES)), ((F.col("seq") - 1) % 13 + 1).cast("int"))
    rows = commands.withColumn("op", op).withColumn("palette", F.array_sort(F.collect_set("material").over(whole))).withColumn("ms", F.size("palette"))
    return rows.select("scene", "seq", "ms", "palette", canonical.command_bits(F.col("op"), DIMS, F.col("ms"), F.col("axis"), F.lit(6)).alias("bits"))


@query("body_bits", sql("scene seq bits", "SELECT scene, seq, bits FROM bits", BITS))
def _(spark, d):
    return _bits(spark, d).select("scene", "seq", "bits")


@query("profile_header_bytes", sql("scene bytes", f"SELECT scene, 3 + {vl('count(DISTINCT material)')} + sum(DISTINCT material) * 0 + count(DISTINCT material) + {vl('count(*)')} AS bytes FROM cmds GROUP BY scene", CMDS))
def _(spark, d):
    rows = _bits(spark, d).groupBy("scene").agg(F.first("palette").alias("palette"), F.count(F.lit(1)).alias("n"))
    return rows.select("scene", canonical.profile_header_bytes(DIMS, F.col("palette"), F.col("n")).alias("bytes"))


_BOX_FIELDS = ("material", "ox", "oy", "oz", "sx - 1", "sy - 1", "sz - 1")
AUDIT = f"""{CMDS}, sizes AS (SELECT scene, 1 + 3 + {vl('n')} + written AS source_bytes, 8 + 3 + {vl('ms')} + palette + {vl('n')} + (n * (34 + length(ltrim(bin(greatest(ms - 1, 1)), '0'))) + 7) // 8 + 1 AS compact_bytes
 FROM (SELECT scene, count(*) AS n, count(DISTINCT material) AS ms, sum(1 + {' + '.join(vl(f) for f in _BOX_FIELDS)}) AS written FROM cmds GROUP BY scene) AS a JOIN (SELECT scene, sum({vl('material')}) AS palette FROM (SELECT DISTINCT scene, material FROM cmds) AS m GROUP BY scene) AS b USING (scene))"""


def _audit(spark, d):
    """The sizes of the scenes' box programs in the legacy and in the compact form."""
    written = sum((S.varint_length(F.expr(f)) for f in _BOX_FIELDS), F.lit(1))
    rows = A.commands(spark, d).groupBy("scene").agg(F.array_sort(F.collect_set("material")).alias("palette"), F.count(F.lit(1)).alias("n"), F.sum(written).alias("written"))
    bits = F.col("n") * canonical.command_bits(F.lit("box"), DIMS, F.size("palette"), F.lit(0), F.lit(0))
    compact = 8 + canonical.profile_header_bytes(DIMS, F.col("palette"), F.col("n")) + F.floor((bits + 7) / 8) + 1
    source = 4 + S.varint_length("n") + F.col("written")
    return canonical.audited(rows.select("scene", source.alias("source_bytes"), compact.alias("compact_bytes")))


@query("audit", sql("scene source_bytes compact_bytes saved_bytes saved_bps selected:s deep_search:b", "SELECT *, source_bytes - compact_bytes AS saved_bytes, CAST(trunc(CAST((source_bytes - compact_bytes) * 10000 AS DOUBLE) / source_bytes) AS BIGINT) AS saved_bps, CASE WHEN compact_bytes < source_bytes THEN 'compact' ELSE 'source' END AS selected, compact_bytes <= source_bytes + 16 AS deep_search FROM sizes", AUDIT))
def _(spark, d):
    return _audit(spark, d)


@query("format_selection", sql("selected:s scenes bytes", "SELECT CASE WHEN compact_bytes < source_bytes THEN 'compact' ELSE 'source' END AS selected, count(*) AS scenes, sum(least(compact_bytes, source_bytes)) AS bytes FROM sizes GROUP BY 1", AUDIT))
def _(spark, d):
    return _audit(spark, d).groupBy("selected").agg(F.count(F.lit(1)).alias("scenes"), F.sum(F.least("compact_bytes", "source_bytes")).alias("bytes"))


# ---- verification --------------------------------------------------------------------------


@query("report", sql("scene exact:b improved:b accepted:b mismatches saved_bytes saved_bps", """SELECT *, exact AND improved AS accepted FROM (SELECT scene, coalesce(mm, 0) = 0 AS exact, compact_bytes < source_bytes AS improved, coalesce(mm, 0) AS mismatches, source_bytes - compact_bytes AS saved_bytes,
 CAST(trunc(CAST((source_bytes - compact_bytes) * 10000 AS DOUBLE) / source_bytes) AS BIGINT) AS saved_bps FROM sizes LEFT JOIN (SELECT scene, count(*) AS mm FROM pairs WHERE want IS DISTINCT FROM have GROUP BY scene) AS x USING (scene)) AS r""", f"{PAIRS}, {AUDIT.removeprefix(CMDS + ', ')}"))  # fmt: skip
def _(spark, d):
    return verification.report(_audit(spark, d), D.mismatches(pairs(spark, d)))


@query("verify_pairs", sql("scene equal:b", f"""SELECT coalesce(a.scene, b.scene) AS scene, coalesce(a.root = b.root, FALSE) AS equal FROM (SELECT scene, root FROM ({_BUILDING.replace('voxels) AS g', 'want) AS g')}) AS x) AS a
 FULL JOIN (SELECT scene, root FROM ({_BUILDING.replace('voxels) AS g', 'have) AS g')}) AS y) AS b ON a.scene = b.scene""", _PAIRS))  # fmt: skip
def _(spark, d):
    target, base = state.last_writer(laid(spark, d)), state.as_of(laid(spark, d), F.lit(4 * geometry.SUBS))
    return verification.same_roots(canonical.building_roots(target, DIMS), canonical.building_roots(base, DIMS))


QUADS = f"quads AS ({A.SQL_QUADS})"


@query("quad_overlaps", sql("owner first second", "SELECT a.owner, a.quad AS first, b.quad AS second FROM quads AS a JOIN quads AS b ON a.owner = b.owner AND a.axis = b.axis AND a.side = b.side AND a.plane = b.plane AND a.quad < b.quad AND a.u0 < b.u1 AND b.u0 < a.u1 AND a.v0 < b.v1 AND b.v0 < a.v1", QUADS))
def _(spark, d):
    return quads.overlaps(A.quads(spark, d))


_FACES = """SELECT *, CASE axis WHEN 0 THEN {p} ELSE u END AS x, CASE axis WHEN 0 THEN u WHEN 1 THEN {p} ELSE v END AS y, CASE axis WHEN 2 THEN {p} ELSE v END AS z
 FROM (SELECT *, u0 + c % (u1 - u0) AS u, v0 + c // (u1 - u0) AS v FROM (SELECT *, unnest(range(0, (u1 - u0) * (v1 - v0))) AS c FROM quads) AS e) AS f"""
_HELD = "EXISTS (SELECT 1 FROM forge WHERE forge.component = owner AND x BETWEEN 0 AND 13 AND y BETWEEN 0 AND 9 AND z BETWEEN 0 AND 13 AND forge.cell = x + 14 * (y + 10 * z))"


@query("surface_violations", sql("owner quad bare internal", f"""SELECT owner, quad, count(*) FILTER (WHERE NOT held) AS bare, count(*) FILTER (WHERE held AND hidden) AS internal FROM
 (SELECT a.owner, a.quad, held, hidden FROM a JOIN b ON a.quad = b.quad AND a.c = b.c) AS t GROUP BY owner, quad HAVING bare > 0 OR internal > 0""",
 f"{QUADS}, {FORGE}, a AS (SELECT owner, quad, c, {_HELD} AS held FROM ({_FACES.format(p='(plane - side)')}) AS g), b AS (SELECT quad, c, {_HELD} AS hidden FROM ({_FACES.format(p='(plane - 1 + side)')}) AS g)"))
def _(spark, d):
    return quads.faults(A.quads(spark, d), A.forge(spark, d))


# ---- baselines -----------------------------------------------------------------------------

_T_ISLE = _ISLE.format(keys="scene", rows="(SELECT DISTINCT scene, id FROM terrain) AS u")
for _least in (1, 2, 3, 4):
    query(f"base_runs_{_least}", sql("scene start length", f"SELECT * FROM ({_T_ISLE}) AS r WHERE length >= {_least}", TERRAIN))(lambda spark, d, n=_least: baselines.terrain_runs(A.terrain(spark, d), n))


for _least in (1, 2, 32, 64, 128):
    query(f"base_layers_{_least}", sql("scene y bits", f"SELECT scene, id // 256 AS y, count(DISTINCT id) AS bits FROM terrain GROUP BY 1, 2 HAVING count(DISTINCT id) >= {_least}", TERRAIN))(
        lambda spark, d, n=_least: baselines.terrain_layers(A.terrain(spark, d), n)
    )


_XYZ = ", ".join(f"{f}({e}) AS {c}{i}" for c, e in (("x", "id % {a}"), ("y", "id // ({a} * {b})"), ("z", "id // {a} % {b}")) for i, f in enumerate(("min", "max")))


@query("base_bbox", sql("scene x0 x1 y0 y1 z0 z1 cells", f"SELECT scene, {_XYZ.format(a=16, b=16)}, count(*) AS cells FROM (SELECT DISTINCT scene, id FROM terrain) AS t GROUP BY scene", TERRAIN))
def _(spark, d):
    return baselines.bounds(A.terrain(spark, d).select("scene", "id").distinct(), ["scene"], 16, 16)


@query("base_material_bbox", sql("scene material x0 x1 y0 y1 z0 z1 cells", f"SELECT scene, material, {_XYZ.format(a=32, b=32)}, count(*) AS cells FROM voxels GROUP BY scene, material", _DRAWN))
def _(spark, d):
    return baselines.bounds(_drawn(spark, d), ["scene", "material"], 32, 32)


for _axis, (_step, _keys) in enumerate((("id % 32", "id // 32"), ("id // 1024", "id % 1024"), ("id // 32 % 32", "id % 32, id // 1024"))):
    query(f"base_axis_runs_{'xyz'[_axis]}", sql("scene material start length", f"SELECT scene, material, min(id) AS start, count(*) AS length FROM (SELECT scene, material, id, {_step} - row_number() OVER (PARTITION BY scene, material, {_keys} ORDER BY {_step}) AS island, {_keys.replace(', ', ' AS k1, ') + (' AS k2' if ',' in _keys else ' AS k1')} FROM voxels) AS t GROUP BY scene, material, island, k1{', k2' if ',' in _keys else ''} HAVING count(*) >= 2", _DRAWN))(
        lambda spark, d, axis=_axis: baselines.axis_runs(_drawn(spark, d), axis, DIMS)
    )


for _axis, (_first, _place) in enumerate((("id % 32 = 0", "id // 1024 + 32 * (id // 32 % 32)"), ("id < 1024", "id"), ("id // 32 % 32 = 0", "id % 32 + 32 * (id // 1024)"))):

    @query(f"base_slice_extrude_{'xyz'[_axis]}", sql("scene material axis u v depth cells:s", f"""SELECT scene, material, {_axis} AS axis, 32 AS u, 32 AS v, 32 AS depth, string_agg(CAST({_place} AS VARCHAR), ',' ORDER BY {_place}) AS cells
 FROM voxels WHERE {_first} GROUP BY scene, material""", _DRAWN))  # fmt: skip
    def _(spark, d, axis=_axis):
        return baselines.slice_extrusions(_drawn(spark, d), axis, DIMS).withColumn("cells", F.array_join("cells", ","))


@query("base_greedy_boxes", sql("scene covered materials", "SELECT scene, count(*) AS covered, sum(material) AS materials FROM voxels GROUP BY scene", _DRAWN))
def _(spark, d):
    found = baselines.greedy_boxes(_drawn(spark, d), DIMS).withColumn("n", F.expr("w * h * d"))
    return found.groupBy("scene").agg(F.sum("n").alias("covered"), F.sum(F.col("n") * F.col("material")).alias("materials"))


_U = K.TERRAIN_GRID[0] * K.TERRAIN_GRID[1] * K.TERRAIN_GRID[2]
_HEAD = f"8 + {vl('zz')}"
_LOW = f"CAST(floor(log2({_U} // n)) AS BIGINT)"


@query("base_best", sql("scene sparse split runs layers best:s bytes", f"""SELECT scene, sparse, split, runs, layers, least(sparse, split, runs, layers) AS bytes,
 CASE least(sparse, split, runs, layers) WHEN sparse THEN 'sparse' WHEN split THEN 'split' WHEN runs THEN 'runs' ELSE 'layers' END AS best FROM
 (SELECT scene, {_HEAD} + 1 + {vl('n')} + gaps AS sparse, {_HEAD} + 2 + 1 + {vl('n')} + 1 + (n * {_LOW} + 7) // 8 + (({_U - 1} >> CAST({_LOW} AS INT)) + n + 1 + 7) // 8 AS split,
 {_HEAD} + {vl('k')} + pieces + 1 AS runs, {_HEAD} + {vl('l')} + heights + 33 * l + 1 AS layers
 FROM (SELECT scene, CASE WHEN any_value(min_y) >= 0 THEN 2 * any_value(min_y) ELSE -2 * any_value(min_y) - 1 END AS zz, count(*) AS n, sum(1 + {vl('gap')}) AS gaps FROM
 (SELECT *, coalesce(id - lag(id) OVER (PARTITION BY scene ORDER BY id) - 1, id) AS gap FROM (SELECT DISTINCT scene, id, min_y FROM terrain) AS u) AS g GROUP BY scene) AS a
 JOIN (SELECT scene, count(*) AS k, sum(1 + {vl('start')} + {vl('length')}) AS pieces FROM ({_T_ISLE}) AS r GROUP BY scene) AS b USING (scene)
 JOIN (SELECT scene, count(*) AS l, sum({vl('y')}) AS heights FROM (SELECT DISTINCT scene, id // 256 AS y FROM terrain) AS t GROUP BY scene) AS c USING (scene)) AS e""", TERRAIN))  # fmt: skip
def _(spark, d):
    """The bytes of the exact programs of a terrain: patches alone, the split code, all runs, all layers."""
    return baselines.terrain_bytes(A.terrain(spark, d))


# ---- search --------------------------------------------------------------------------------

CANDIDATES = f"candidates AS ({A.SQL_CANDIDATES})"
_FIT = "mismatches > 0, mismatches, bytes, units, encoding, slot"
RANKED = f"{CANDIDATES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY {_FIT}) AS rank FROM candidates)"


@query("fitness_order", sql("island slot rank", "SELECT island, slot, rank FROM ranked", RANKED))
def _(spark, d):
    return population.ranked(A.candidates(spark, d)).select("island", "slot", "rank")


@query("elites", sql("island slot rank bytes", "SELECT * FROM ranked WHERE rank <= 4", RANKED))
def _(spark, d):
    return population.elites(A.candidates(spark, d), 4).select("island", "slot", "rank", "bytes")


_RANKED_SCENES = f"""ops AS (SELECT scene, count(*) AS ops FROM cmds WHERE seq < 4 GROUP BY scene),
 stats AS (SELECT scene, m AS mismatches, sets, paints, runs FROM (SELECT scene, count(*) AS m, count(*) FILTER (kind = 0) AS sets, count(*) FILTER (kind = 2) AS paints FROM patches GROUP BY scene) AS a JOIN (SELECT scene, count(*) AS runs FROM ({RUNS}) AS r GROUP BY scene) AS b USING (scene)),
 costed AS (SELECT scene % 8 AS island, scene AS slot, scene % 11 > 0 AS valid, ops, coalesce(mismatches, 0) AS mismatches,
 6 * ops + scene % 5 + least(3 * coalesce(mismatches, 0) + coalesce(sets, 0) + coalesce(paints, 0), 6 * coalesce(runs, 0), 4096 + 2 * coalesce(paints, 0)) AS cost FROM ops LEFT JOIN stats USING (scene))"""


@query("survivors", sql("island slot rank cost", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY island ORDER BY NOT valid, cost, mismatches, ops, slot) AS rank FROM costed) AS r WHERE rank <= 8", f"{PATCHES}, {_RANKED_SCENES}"))
def _(spark, d):
    """Every scene's first commands as a candidate for the whole scene, ranked from the statistics of what differs."""
    ops = A.commands(spark, d).filter("seq < 4").groupBy("scene").agg(F.count(F.lit(1)).alias("ops"))
    stats = D.prefilter_stats(pairs(spark, d))
    found = ops.join(stats, "scene", "left").fillna(0, ["mismatches", "sets", "paints", "runs"])
    ranked = found.select("*", (F.col("scene") % 8).alias("island"), F.col("scene").alias("slot"), (F.col("scene") % 11 > 0).alias("valid"), (F.col("scene") % 5).alias("mask_bytes"), F.lit(32**3).cast("long").alias("volume"))
    return population.survivors(ranked, 8).select("island", "slot", "rank", "cost")


@query("inject_best", sql("island rank mismatches bytes units encoding:s", f"""SELECT r.island, r.rank, CASE WHEN swap THEN b.mismatches ELSE r.mismatches END AS mismatches, CASE WHEN swap THEN b.bytes ELSE r.bytes END AS bytes, CASE WHEN swap THEN b.units ELSE r.units END AS units,
 CASE WHEN swap THEN b.encoding ELSE r.encoding END AS encoding FROM (SELECT a.*, a.rank = max(a.rank) OVER (PARTITION BY a.island) AND NOT bool_or(a.encoding = (SELECT encoding FROM best)) OVER (PARTITION BY a.island) AS swap FROM ranked AS a) AS r, best AS b""",
 f"{RANKED}, best AS (SELECT * FROM candidates ORDER BY {_FIT} LIMIT 1)"))
def _(spark, d):
    return population.inject_best(A.candidates(spark, d))


@query("seen_dedup", sql("island slot fresh:b", "SELECT island, slot, row_number() OVER (PARTITION BY island, encoding ORDER BY slot) = 1 AS fresh FROM candidates", CANDIDATES))
def _(spark, d):
    return population.first_seen(A.candidates(spark, d)).select("island", "slot", "fresh")


@query("progress", sql("island attempts exact best_bytes", "SELECT island, count(*) AS attempts, count(*) FILTER (mismatches = 0) AS exact, min(bytes) FILTER (mismatches = 0) AS best_bytes FROM candidates GROUP BY island", CANDIDATES))
def _(spark, d):
    return population.progress(A.candidates(spark, d))


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: the cheapest residual codec of every scene."""
    return QUERIES["residual_best"](spark, "/root/testdata/sf0.001")
