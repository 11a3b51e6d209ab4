"""Queries of the core library, and the SQL that each is checked against.

The SQL is written from the definitions alone (unions of faces, recursive components),
so it shares no code with the DataFrame plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import affinity as A
from lattica.functions import scores as S
from lattica.functions.thresholds import voi_limits
from lattica.operators import blocks, components, flow, fragments, geometry, graph, labels, merge, metrics
from lattica.plans.api import segment_frames
from lattica.session import cut
from lattica.sources import lattice as L

LOW, HIGH = A.LOW * 255, A.HIGH * 255
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


# -- SQL building blocks ---------------------------------------------------------------

_DIMS = """dims AS (SELECT CASE WHEN n <= 1000 THEN 10 WHEN n <= 10000 THEN 25 ELSE 50 END AS Y,
  CASE WHEN n <= 1000 THEN 10 WHEN n <= 10000 THEN 40 ELSE 50 END AS X, n FROM (SELECT count(*) AS n FROM events)),
shape AS (SELECT Y, X, CAST(ceil(n / (Y * X)) AS BIGINT) AS Z FROM dims)"""


def _lat(az: str, ay: str, ax: str, source: str = "events") -> str:
    return f"""{_DIMS}, lat AS (SELECT event_id AS vox, event_id // (Y * X) AS z, (event_id // X) % Y AS y, event_id % X AS x,
  {az} AS az, {ay} AS ay, {ax} AS ax, Y * X AS sz, X AS sy FROM {source}, shape)"""


_LEVELS = _lat("CAST(floor(value) AS BIGINT) % 4 * 85", "CAST(floor(value * 10) AS BIGINT) % 4 * 85", "user_id % 4 * 85")
_RANKED = "(SELECT *, row_number() OVER (ORDER BY value, event_id) AS r FROM events)"
_TIEFREE = _lat("3 * r", "3 * r + 1", "3 * r + 2", _RANKED)
_FACES = """fc AS (SELECT vox, vox - sz AS nbr, 0 AS axis, az AS aff FROM lat WHERE z > 0
  UNION ALL SELECT vox, vox - sy, 1, ay FROM lat WHERE y > 0 UNION ALL SELECT vox, vox - 1, 2, ax FROM lat WHERE x > 0),
sides AS (SELECT vox, axis AS d, aff FROM fc UNION ALL SELECT nbr, axis + 3, aff FROM fc)"""
_OFFSETS = "CASE d WHEN 0 THEN -sz WHEN 1 THEN -sy WHEN 2 THEN -1 WHEN 3 THEN sz WHEN 4 THEN sy ELSE 1 END"


def _bits(low: str = repr(LOW), high: str = repr(HIGH), rule: str = "aff = m OR aff >= {high}") -> str:
    return f"""mx AS (SELECT *, max(aff) OVER (PARTITION BY vox) AS m FROM sides),
bits AS (SELECT lat.vox, CAST(coalesce(sum(CASE WHEN m > {low} AND ({rule.format(low=low, high=high)}) THEN 1 << d ELSE 0 END), 0) AS INTEGER) AS bits
  FROM lat LEFT JOIN mx ON mx.vox = lat.vox GROUP BY lat.vox),
dir AS (SELECT b.vox, d, b.vox + {_OFFSETS} AS nbr FROM bits b JOIN lat USING (vox), range(6) t(d) WHERE (b.bits >> CAST(d AS INTEGER)) & 1 = 1),
pair AS (SELECT least(vox, nbr) AS a, greatest(vox, nbr) AS b, bool_or(vox < nbr) AS forward, bool_or(vox > nbr) AS back FROM dir GROUP BY 1, 2)"""


def _cc(edges: str, nodes: str, name: str = "cc") -> str:
    """Components (n, l) of edges (a, b) over nodes (n)."""
    return f"""{name}_sym AS (SELECT a, b FROM ({edges}) UNION ALL SELECT b, a FROM ({edges})),
{name}(n, l) USING KEY (n) AS (SELECT n, n FROM ({nodes}) UNION
  SELECT s.b, min({name}.l) FROM {name} JOIN {name}_sym s ON s.a = {name}.n JOIN recurring.{name} k ON k.n = s.b WHERE {name}.l < k.l GROUP BY s.b)"""


_W = f"WITH RECURSIVE {_LEVELS}, {_FACES}"
_BLOCKS = "fr AS (SELECT vox, CASE WHEN vox % 17 = 0 THEN 0 ELSE z // 5 * 10000 + y // 5 * 100 + x // 5 + 1 END AS frag FROM lat)"
_TOUCH = "ct AS (SELECT least(p.frag, q.frag) AS u, greatest(p.frag, q.frag) AS v, aff FROM fc JOIN fr p ON p.vox = fc.vox JOIN fr q ON q.vox = fc.nbr WHERE p.frag <> q.frag AND p.frag > 0 AND q.frag > 0)"
_RAG = "rag AS (SELECT u, v, CAST(sum(aff) AS BIGINT) AS sum_bytes, count(*) AS cnt FROM ct GROUP BY u, v)"
_BLOCK_GRAPH = f"{_W}, {_BLOCKS}, {_TOUCH}, {_RAG}"


def _blocks(spark: SparkSession, sf_dir: str):
    lattice, shape = L.events_lattice(spark, sf_dir)
    return lattice, shape, L.block_fragments(lattice)


def _block_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    lattice, shape, frags = _blocks(spark, sf_dir)
    return graph.region_graph(lattice, frags, shape)


def _block_contacts(spark: SparkSession, sf_dir: str):
    lattice, shape, frags = _blocks(spark, sf_dir)
    return graph.contacts(lattice, frags, shape), fragments.sizes(frags)


def _level_bits(spark: SparkSession, sf_dir: str, **more):
    lattice, shape = L.events_lattice(spark, sf_dir)
    return flow.flow(lattice, shape, LOW, HIGH, **more), shape


# -- scalar functions ------------------------------------------------------------------


@query("quantise_u8", "SELECT event_id, CAST(least(greatest(round_even(CAST(CAST(value / 600.0 AS FLOAT) * CAST(255 AS FLOAT) AS DOUBLE), 0), 0), 255) AS INTEGER) AS byte FROM events")
def _(spark, sf_dir):
    return L.table(spark, sf_dir, "events").select("event_id", A.quantise((F.col("value") / 600.0).cast("float")).alias("byte"))


@query("dequantise", "SELECT event_id, round(CAST(CAST(CAST(CAST(floor(value) AS BIGINT) % 256 AS DOUBLE) / 255 AS FLOAT) AS DOUBLE), 9) AS aff FROM events")
def _(spark, sf_dir):
    return L.table(spark, sf_dir, "events").select("event_id", F.round(A.dequantise(F.pmod(F.floor("value"), F.lit(256))).cast("double"), 9).alias("aff"))


@query("discretise", "SELECT event_id, CAST(least(floor(value / 600.0 * 16), 15) AS INTEGER) AS bin, (least(floor(value / 600.0 * 16), 15) + 0.5) / 16 AS middle FROM events")
def _(spark, sf_dir):
    bin_ = A.discretise(F.col("value") / 600.0, 16)
    return L.table(spark, sf_dir, "events").select("event_id", bin_.alias("bin"), A.undiscretise(bin_, 16).alias("middle"))


# -- flow ------------------------------------------------------------------------------


@query("flow_bits", f"{_W}, {_bits()} SELECT vox, bits FROM bits")
def _(spark, sf_dir):
    return _level_bits(spark, sf_dir)[0]


@query("flow_tieflip", f"{_W}, {_bits(rule='(aff = m AND d = (SELECT max(o.d) FROM sides o WHERE o.vox = mx.vox AND o.aff = mx.m)) OR aff >= {high}')} SELECT vox, bits FROM bits")
def _(spark, sf_dir):
    return _level_bits(spark, sf_dir, tie_flip=True)[0]


@query("flow_coarse", f"{_W}, {_bits(rule='aff = m OR aff >= {high} OR (aff >= m - 85 AND aff > {low})')} SELECT vox, bits FROM bits")
def _(spark, sf_dir):
    return _level_bits(spark, sf_dir, coarse=85.0)[0]


@query("flow_edges", f"{_W}, {_bits()} SELECT a, b, forward, back FROM pair")
def _(spark, sf_dir):
    return flow.flow_edges(*_level_bits(spark, sf_dir))


@query("reciprocal_edges", f"{_W}, {_bits()} SELECT a, b FROM pair WHERE forward AND back")
def _(spark, sf_dir):
    return flow.reciprocal_edges(*_level_bits(spark, sf_dir))


@query("corner_voxels", f"{_W}, {_bits()} SELECT DISTINCT CASE WHEN forward THEN a ELSE b END AS vox FROM pair WHERE forward <> back")
def _(spark, sf_dir):
    return flow.corners(*_level_bits(spark, sf_dir))


@query("slab_face_clear", f"{_W}, {_bits()} SELECT vox, CAST(bits & ~(CASE WHEN lat.z % 4 = 0 THEN 1 ELSE 0 END) & ~(CASE WHEN lat.z % 4 = 3 OR lat.z = shape.Z - 1 THEN 8 ELSE 0 END) AS INTEGER) AS bits FROM bits JOIN lat USING (vox), shape")
def _(spark, sf_dir):
    bits, shape = _level_bits(spark, sf_dir)
    return flow.clear_slab_faces(bits, shape, 4)


# -- components and fragments ----------------------------------------------------------


@query("plateau_components", f"{_W}, {_bits()}, {_cc('SELECT a, b FROM pair WHERE forward AND back', 'SELECT DISTINCT unnest([a, b]) AS n FROM pair WHERE forward AND back')} SELECT n AS vox, l AS root FROM cc")
def _(spark, sf_dir):
    return fragments.plateaus(*_level_bits(spark, sf_dir)).select("vox", "root")


@query("plateau_sizes", f"{_W}, {_bits()}, {_cc('SELECT a, b FROM pair WHERE forward AND back', 'SELECT DISTINCT unnest([a, b]) AS n FROM pair WHERE forward AND back')} SELECT l AS root, count(*) AS size FROM cc GROUP BY l")
def _(spark, sf_dir):
    return fragments.plateaus(*_level_bits(spark, sf_dir)).groupBy("root").agg(F.count("*").alias("size"))


_TIEFREE_FRAGS = f"""WITH RECURSIVE {_TIEFREE}, {_FACES}, {_bits('0', '1e300')}, {_cc('SELECT a, b FROM pair', 'SELECT DISTINCT unnest([a, b]) AS n FROM pair')},
fr AS (SELECT lat.vox, coalesce(frag, 0) AS frag FROM lat LEFT JOIN (SELECT n, dense_rank() OVER (ORDER BY l) AS frag FROM cc) c ON c.n = lat.vox)"""


def _tiefree(spark, sf_dir):
    lattice, shape = L.events_lattice_tiefree(spark, sf_dir)
    lattice = cut(lattice)
    return lattice, shape, cut(fragments.watershed(lattice, shape, 0.0, 1e300))


@query("watershed_tiefree", f"{_TIEFREE_FRAGS} SELECT vox, frag FROM fr")
def _(spark, sf_dir):
    return _tiefree(spark, sf_dir)[2]


@query("fragment_sizes", f"{_TIEFREE_FRAGS} SELECT frag, count(*) AS size FROM fr WHERE frag <> 0 GROUP BY frag")
def _(spark, sf_dir):
    return fragments.sizes(_tiefree(spark, sf_dir)[2])


@query("watershed_plateau")
def _(spark, sf_dir):
    lattice, shape = L.events_lattice(spark, sf_dir)
    return fragments.watershed(lattice, shape, LOW, HIGH)


@query("watershed_slabs")
def _(spark, sf_dir):
    lattice, shape = L.events_lattice(spark, sf_dir)
    return fragments.watershed(lattice, shape, LOW, HIGH, slab=4)


@query(
    "watershed_slabs_tiefree",
    f"""WITH RECURSIVE {_TIEFREE}, {_FACES}, {_bits('0', '1e300')},
cleared AS (SELECT bits.vox, CAST(bits & ~(CASE WHEN lat.z % 4 = 0 THEN 1 ELSE 0 END) & ~(CASE WHEN lat.z % 4 = 3 OR lat.z = shape.Z - 1 THEN 8 ELSE 0 END) AS INTEGER) AS bits FROM bits JOIN lat USING (vox), shape),
flows AS (SELECT c.vox AS a, c.vox + {_OFFSETS} AS b FROM cleared c JOIN lat USING (vox), range(6) t(d) WHERE (c.bits >> CAST(d AS INTEGER)) & 1 = 1),
{_cc('SELECT a, b FROM flows', 'SELECT DISTINCT unnest([a, b]) AS n FROM flows')}
SELECT lat.vox, coalesce(frag, 0) AS frag FROM lat LEFT JOIN (SELECT n, dense_rank() OVER (ORDER BY l) AS frag FROM cc) c ON c.n = lat.vox""",
)
def _(spark, sf_dir):
    lattice, shape = L.events_lattice_tiefree(spark, sf_dir)
    return fragments.watershed(cut(lattice), shape, 0.0, 1e300, slab=4)


@query("watershed_relational", f"{_TIEFREE_FRAGS} SELECT vox, frag FROM fr")
def _(spark, sf_dir):
    lattice, shape = L.events_lattice_tiefree(spark, sf_dir)
    return fragments.watershed_relational(cut(lattice), shape, 0.0, 1e300)


@query("components_by_block", f"{_W}, {_bits()}, {_cc('SELECT a, b FROM pair WHERE forward AND back', 'SELECT DISTINCT unnest([a, b]) AS n FROM pair WHERE forward AND back')} SELECT n AS node, l AS root FROM cc")
def _(spark, sf_dir):
    bits, shape = _level_bits(spark, sf_dir)
    return blocks.components_by_block(flow.reciprocal_edges(bits, shape), lambda vox: F.floor(vox / (4 * shape.strides[0])))


@query("block_check", f"{_W}, {_BLOCKS} SELECT CAST(z // 2 AS INTEGER) AS bz, CAST(y // 2 AS INTEGER) AS \"by\", CAST(x // 2 AS INTEGER) AS bx, count(DISTINCT frag) AS labels FROM fr JOIN lat USING (vox) GROUP BY z // 2, y // 2, x // 2 HAVING count(DISTINCT frag) > 1")
def _(spark, sf_dir):
    lattice, _, frags = _blocks(spark, sf_dir)
    return blocks.undivided_blocks(frags, blocks.block_ids(lattice))


@query("flow_summary", f"{_W}, {_bits()} SELECT count(*) FILTER (WHERE bit_count(bits) = 0) AS none, count(*) FILTER (WHERE bit_count(bits) = 1) AS one, count(*) FILTER (WHERE bit_count(bits) > 1) AS several FROM bits")
def _(spark, sf_dir):
    return fragments.flow_summary(_level_bits(spark, sf_dir)[0])


@query("plateau_histogram", f"{_W}, {_bits()}, {_cc('SELECT a, b FROM pair WHERE forward AND back', 'SELECT DISTINCT unnest([a, b]) AS n FROM pair WHERE forward AND back')} SELECT CAST(floor(log2(size)) AS INTEGER) AS bin, count(*) AS n FROM (SELECT count(*) AS size FROM cc GROUP BY l) GROUP BY 1")
def _(spark, sf_dir):
    plateaus = fragments.plateaus(*_level_bits(spark, sf_dir))
    return fragments.size_histogram(plateaus.groupBy("root").agg(F.count("*").alias("size")))


@query("nfrag_bg", f"{_W}, {_BLOCKS} SELECT count(DISTINCT CASE WHEN frag <> 0 THEN frag END) AS n_fragments, max(frag) AS max_id, count(*) FILTER (WHERE frag = 0) AS background FROM fr")
def _(spark, sf_dir):
    return fragments.summary(_blocks(spark, sf_dir)[2])


@query("label_offset", f"{_W}, {_BLOCKS} SELECT vox, CASE WHEN frag <> 0 THEN frag + 1000000 ELSE 0 END AS frag FROM fr")
def _(spark, sf_dir):
    return labels.offset(_blocks(spark, sf_dir)[2], 1_000_000)


@query("relabel_canonical", f"{_W}, {_BLOCKS}, f1 AS (SELECT frag, dense_rank() OVER (ORDER BY min(vox)) AS n FROM fr WHERE frag <> 0 GROUP BY frag) SELECT vox, coalesce(n, 0) AS frag FROM fr LEFT JOIN f1 USING (frag)")
def _(spark, sf_dir):
    return fragments.relabel(_blocks(spark, sf_dir)[2])


# -- region graph and statistics -------------------------------------------------------


@query("rag_contact_mean", f"{_BLOCK_GRAPH} SELECT u, v, sum_bytes, cnt, round(sum_bytes / 255.0 / cnt, 9) AS mean FROM rag")
def _(spark, sf_dir):
    return _block_graph(spark, sf_dir).withColumn("mean", F.round(A.mean_affinity(F.col("sum_bytes"), F.col("cnt")), 9))


@query("rag_tiefree", f"{_TIEFREE_FRAGS}, {_TOUCH} SELECT u, v, CAST(sum(aff) AS BIGINT) AS sum_bytes, count(*) AS cnt FROM ct GROUP BY u, v")
def _(spark, sf_dir):
    lattice, shape, frags = _tiefree(spark, sf_dir)
    return graph.region_graph(lattice, frags, shape)


_STATS = f"""{_W}, {_BLOCKS}, {_TOUCH}, sz AS (SELECT frag, count(*) AS size FROM fr WHERE frag > 0 GROUP BY frag),
st AS (SELECT u, v, count(*) AS cnt, sum(aff) / 255.0 AS total, min(aff / 255.0) AS mn, greatest(0.0, max(aff / 255.0)) AS mx, list_sort(list(aff / 255.0)) AS vals FROM ct GROUP BY u, v),
s2 AS (SELECT st.*, a.size AS su, b.size AS sv FROM st JOIN sz a ON a.frag = u JOIN sz b ON b.frag = v)"""


def _score(name: str, score: S.Score, sql: str):
    @query(f"score_{name}", f"{_STATS} SELECT u, v, round(CAST({sql} AS DOUBLE), 9) AS score FROM s2")
    def _(spark, sf_dir):
        contacts, sizes = _block_contacts(spark, sf_dir)
        return graph.scored(contacts, score, sizes).select("u", "v", F.round("score", 9).alias("score"))


_MEAN = "(total / cnt)"
_score("min_size", S.MinSize(), "least(su, sv)")
_score("max_size", S.MaxSize(), "greatest(su, sv)")
_score("min_affinity", S.MinAffinity(), "mn")
_score("max_affinity", S.MaxAffinity(), "mx")
_score("mean_affinity", S.MeanAffinity(), _MEAN)
_score("contact_area", S.ContactArea(), "cnt")
_score("quantile_75", S.QuantileAffinity(75, False), "vals[least(cnt * 75 // 100, cnt - 1) + 1]")
_score("quantile_50_max", S.QuantileAffinity(50, True), "mx")
_score("histogram_quantile_25", S.HistogramQuantileAffinity(25, 16, False), "(least(floor(vals[least(cnt * 25 // 100, cnt - 1) + 1] * 16), 15) + 0.5) / 16")
_score("histogram_quantile_100", S.HistogramQuantileAffinity(100, 16, False), "16.5 / 16")
_score("mean_max_3", S.MeanMaxKAffinity(3), "list_avg(list_reverse(vals)[1:3])")
_score("constant", S.Constant(0.25), "0.25")
_score("statistic", S.Statistic("sum"), "total")
_score("one_minus", S.OneMinus(S.MeanAffinity()), f"1 - {_MEAN}")
_score("invert", S.Invert(S.ContactArea()), "1.0 / cnt")
_score("square", S.Square(S.MeanAffinity()), f"{_MEAN} * {_MEAN}")
_score("add", S.Add(S.MeanAffinity(), S.ContactArea()), f"{_MEAN} + cnt")
_score("subtract", S.Subtract(S.MaxAffinity(), S.MinAffinity()), "mx - mn")
_score("multiply", S.Multiply(S.MeanAffinity(), S.ContactArea()), f"{_MEAN} * cnt")
_score("divide", S.Divide(S.MeanAffinity(), S.ContactArea()), f"{_MEAN} / cnt")
_score("step", S.Step(S.MeanAffinity(), S.Constant(0.5)), f"CASE WHEN {_MEAN} < 0.5 THEN 0.0 ELSE 1.0 END")
_score("parsed", S.parse("OneMinus<Multiply<MeanAffinity<RegionGraphType, ScoreValue>, Invert<ContactArea<RegionGraphType>>>>"), f"1 - {_MEAN} / cnt")


_score("random", S.Random(7), "(((u % 2147483647 * 48271 + v % 2147483647 * 69621 + 7 * 16807 + 11) % 2147483647 * 48271) % 2147483647 * 69621) % 2147483647 / 2147483647.0")
S.PROVIDERS["sum_of_squares"] = S.Provider("sum_of_squares", lambda aff: F.sum(aff * aff), lambda a, b: a + b)
_score("provided", S.Statistic("sum_of_squares"), "list_sum([x * x for x in vals])")


@query("rag_histogram", f"{_W}, {_BLOCKS}, {_TOUCH} SELECT u, v, CAST(least(floor(aff / 255.0 * 16), 15) AS INTEGER) AS bin, count(*) AS n FROM ct GROUP BY u, v, bin")
def _(spark, sf_dir):
    return graph.histogram(_block_contacts(spark, sf_dir)[0], 16)


@query("lineitem_contacts", "SELECT l_suppkey + 1 AS u, l_partkey + 1000000 AS v, CAST(sum(CAST(round(l_discount * 100) * 25 AS BIGINT)) AS BIGINT) AS sum_bytes, count(*) AS cnt FROM lineitem GROUP BY u, v")
def _(spark, sf_dir):
    c = L.lineitem_contacts(spark, sf_dir)
    return graph.contract_rows(c.select("u", "v", F.col("aff").cast("long").alias("sum_bytes"), F.lit(1).cast("long").alias("cnt")))


_CONTRACTED = f"""{_BLOCK_GRAPH}, ends AS (SELECT u - u % 4 AS a, v - v % 4 AS b, sum_bytes, cnt FROM rag)
SELECT least(a, b) AS u, greatest(a, b) AS v, CAST(sum(sum_bytes) AS BIGINT) AS sum_bytes, CAST(sum(cnt) AS BIGINT) AS cnt FROM ends WHERE a <> b AND a <> 0 AND b <> 0 GROUP BY 1, 2"""


def _by_fours(spark, sf_dir):
    edges = cut(_block_graph(spark, sf_dir))
    ids = edges.select(F.explode(F.array("u", "v")).alias("frag")).distinct()
    return edges, ids.select("frag", (F.col("frag") - F.col("frag") % 4).alias("root"))


@query("edge_contract", _CONTRACTED)
def _(spark, sf_dir):
    return graph.contract(*_by_fours(spark, sf_dir))


@query("edge_contract_dirty", _CONTRACTED)
def _(spark, sf_dir):
    edges, up = _by_fours(spark, sf_dir)
    return graph.contract_dirty(edges, up).where("u <> 0 and v <> 0")


@query("induced_subgraph", f"{_BLOCK_GRAPH} SELECT u, v, sum_bytes, cnt FROM rag WHERE u < 10000 AND v < 10000")
def _(spark, sf_dir):
    return graph.induced(_block_graph(spark, sf_dir), 10_000)


@query("find_edge", f"{_BLOCK_GRAPH}, q AS (SELECT v AS a, u AS b FROM rag UNION ALL SELECT u, v + 1 FROM rag) SELECT a, b, sum_bytes, cnt FROM q LEFT JOIN rag ON u = least(a, b) AND v = greatest(a, b)")
def _(spark, sf_dir):
    edges = cut(_block_graph(spark, sf_dir))
    pairs = edges.select(F.col("v").alias("a"), F.col("u").alias("b")).unionAll(edges.select("u", F.col("v") + 1))
    return graph.find_edge(edges, pairs)


@query("edge_extremes", f"{_BLOCK_GRAPH} SELECT round(max(sum_bytes / cnt), 9) AS largest_mean, count(*) FILTER (WHERE sum_bytes / cnt >= 120) AS n_above FROM rag")
def _(spark, sf_dir):
    edges = cut(_block_graph(spark, sf_dir))
    above = merge.eligible(edges, 120).agg(F.count("*").alias("n_above"))
    return merge.largest_mean(edges).select(F.round("largest_mean", 9).alias("largest_mean")).join(above, F.lit(True))


# -- merging ---------------------------------------------------------------------------

_CUT = 128.0


@query("frozen_cc_labels", f"{_BLOCK_GRAPH}, {_cc(f'SELECT u AS a, v AS b FROM rag WHERE sum_bytes / cnt > {_CUT}', 'SELECT DISTINCT frag AS n FROM fr WHERE frag > 0')} SELECT fr.vox, coalesce(l, 0) AS label FROM fr LEFT JOIN cc ON cc.n = fr.frag")
def _(spark, sf_dir):
    lattice, shape, frags = _blocks(spark, sf_dir)
    up = merge.frozen(graph.region_graph(lattice, frags, shape), _CUT).withColumnsRenamed({"node": "frag"})
    return labels.extract(frags, up)


def _shaped(spark, sf_dir):
    """A tie-free watershed's fragments with the level lattice's bytes on their contacts."""
    _, shape, frags = _tiefree(spark, sf_dir)
    lattice, _ = L.events_lattice(spark, sf_dir)
    return cut(graph.region_graph(lattice, frags, shape)), frags


#: Tie-free fragments, contacts with the level lattice's bytes, their graph.
_SHAPED = f"""{_TIEFREE_FRAGS},
lev AS (SELECT event_id AS vox, CAST(floor(value) AS BIGINT) % 4 * 85 AS az, CAST(floor(value * 10) AS BIGINT) % 4 * 85 AS ay, user_id % 4 * 85 AS ax FROM events),
fl AS (SELECT fc.vox, fc.nbr, CASE axis WHEN 0 THEN lev.az WHEN 1 THEN lev.ay ELSE lev.ax END AS aff FROM fc JOIN lev USING (vox)),
{_TOUCH.replace('FROM fc', 'FROM fl').replace('fc.', 'fl.')}, {_RAG}"""
#: Roots (frag, root) of rows (a, b): b is merged into a.
_ROOTS = "up(frag, root) AS (SELECT b, a FROM merged UNION ALL SELECT up.frag, m.a FROM up JOIN merged m ON m.b = up.root), top AS (SELECT frag, min(root) AS root FROM up GROUP BY frag)"
#: Rounds in which pairs merge that are each other's best edge: rows of kind 0 are edges, of kind 1 merges (b into a).
_MUTUAL = f"""{_SHAPED}, st(it, kind, a, b, s, n) AS (SELECT 0, 0, u, v, sum_bytes, cnt FROM rag UNION ALL (WITH e AS (SELECT * FROM st WHERE kind = 0),
  ends AS (SELECT unnest([a, b]) AS x, a, b, s, n FROM e WHERE s / n > 127.5),
  best AS (SELECT x, arg_min(struct_pack(a := a, b := b), struct_pack(m := -(s / n), a := a, b := b)) AS p FROM ends GROUP BY x),
  pr AS (SELECT p.a AS a, p.b AS b FROM best GROUP BY 1, 2 HAVING count(*) = 2),
  mv AS (SELECT least(coalesce(x.a, e.a), coalesce(y.a, e.b)) AS a, greatest(coalesce(x.a, e.a), coalesce(y.a, e.b)) AS b, s, n FROM e LEFT JOIN pr x ON x.b = e.a LEFT JOIN pr y ON y.b = e.b)
  SELECT (SELECT max(it) + 1 FROM st), 0, a, b, CAST(sum(s) AS BIGINT), CAST(sum(n) AS BIGINT) FROM mv WHERE a <> b AND EXISTS (SELECT 1 FROM pr) GROUP BY a, b
  UNION ALL SELECT (SELECT max(it) + 1 FROM st), 1, a, b, 0, 0 FROM pr)),
merged AS (SELECT a, b FROM st WHERE kind = 1), {_ROOTS}"""
#: In each component of edges below 0.5 the lowest score merges, one pair a round; rows of kind 0 are edges, of kind 1 merges.
_EXACT = f"""{_SHAPED}, es AS (SELECT u, v, sum_bytes / 255.0 AS s, cnt AS n FROM rag), {_cc('SELECT u AS a, v AS b FROM es WHERE 1 - s / n < 0.5', 'SELECT DISTINCT unnest([u, v]) AS n FROM es WHERE 1 - s / n < 0.5', 'part')},
st(it, kind, c, a, b, s, n) AS (SELECT 0, 0, p.l, u, v, s, es.n FROM es JOIN part p ON p.n = u JOIN part q ON q.n = v WHERE p.l = q.l UNION ALL (WITH e AS (SELECT * FROM st WHERE kind = 0),
  pr AS (SELECT c, arg_min(struct_pack(a := a, b := b, s := 1 - s / n), struct_pack(m := 1 - s / n, a := a, b := b)) AS p FROM e WHERE 1 - s / n < 0.5 GROUP BY c),
  mv AS (SELECT e.c, CASE WHEN e.a = p.b THEN p.a ELSE e.a END AS a, CASE WHEN e.b = p.b THEN p.a ELSE e.b END AS b, e.s, e.n FROM e JOIN pr ON pr.c = e.c)
  SELECT (SELECT max(it) + 1 FROM st), 0, c, least(a, b), greatest(a, b), sum(s), CAST(sum(n) AS BIGINT) FROM mv WHERE a <> b GROUP BY 3, 4, 5
  UNION ALL SELECT (SELECT max(it) + 1 FROM st), 1, c, p.a, p.b, p.s, 0 FROM pr)),
merged AS (SELECT it, c, a, b, s FROM st WHERE kind = 1), {_ROOTS}"""
_LABELS = "SELECT vox, coalesce(top.root, fr.frag) AS label FROM fr LEFT JOIN top ON top.frag = fr.frag"


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("violations"))


def _exact(spark, sf_dir):
    edges, frags = _shaped(spark, sf_dir)
    stats = cut(edges.select("u", "v", "cnt", (F.col("sum_bytes") / 255.0).alias("sum")))
    return edges, frags, stats, merge.exact(stats, [0.3, 0.5])


@query("exact_merge_labels", f"{_EXACT} {_LABELS}")
def _(spark, sf_dir):
    _, frags, _, merged = _exact(spark, sf_dir)
    up = merge.parents_of(merged, frags, [0.5]).select("frag", "root")
    return labels.extract(frags, up)


@query("merge_history", f"{_EXACT} SELECT c AS component, CASE WHEN s < 0.3 THEN 0.3 ELSE 0.5 END AS threshold, CAST(it - 1 AS BIGINT) AS step, a, b, a AS c, round(s, 9) AS score FROM merged")
def _(spark, sf_dir):
    return merge.merge_history(_exact(spark, sf_dir)[3]).withColumn("score", F.round("score", 9))


@query(
    "region_graph_after",
    f"{_EXACT}, ends AS (SELECT coalesce(x.root, u) AS a, coalesce(y.root, v) AS b, sum_bytes, cnt FROM rag LEFT JOIN top x ON x.frag = u LEFT JOIN top y ON y.frag = v) "
    "SELECT least(a, b) AS u, greatest(a, b) AS v, CAST(sum(cnt) AS BIGINT) AS cnt, round(1 - sum(sum_bytes) / 255.0 / sum(cnt), 9) AS score FROM ends WHERE a <> b GROUP BY 1, 2",
)
def _(spark, sf_dir):
    _, _, stats, merged = _exact(spark, sf_dir)
    return merge.region_graph_after(merged, stats, 0.5).withColumn("score", F.round("score", 9))


@query("boruvka_labels", f"{_MUTUAL} {_LABELS}")
def _(spark, sf_dir):
    edges, frags = _shaped(spark, sf_dir)
    return labels.extract(frags, merge.mutual_best_by_component(edges, 127.5))


@query("parhac_labels")
def _(spark, sf_dir):
    edges, frags = _shaped(spark, sf_dir)
    return labels.extract(frags, merge.approximate(edges, [127.5], 0.08).select("frag", "root"))


@query("parhac_bounds", f"{_SHAPED}, {_cc('SELECT u AS a, v AS b FROM rag WHERE sum_bytes / cnt > 127.5', 'SELECT DISTINCT frag AS n FROM fr WHERE frag > 0', 'part')} SELECT CAST(0 AS BIGINT) AS violations, CAST(0 AS BIGINT) AS across, count(*) AS fragments, count(*) FILTER (WHERE alone) AS alone FROM (SELECT l, count(*) = 1 AS alone, n FROM part GROUP BY l, n)".replace("FROM (SELECT l, count(*) = 1 AS alone, n FROM part GROUP BY l, n)", "FROM (SELECT n, count(*) OVER (PARTITION BY l) = 1 AS alone FROM part)"))
def _(spark, sf_dir):
    """What the rounds must keep: no edge left above the threshold, no cluster over two frozen components, lone fragments alone."""
    edges, frags = _shaped(spark, sf_dir)
    found = cut(merge.approximate(edges, [127.5], 0.08).select("frag", "root"))
    own = frags.where("frag <> 0").select("frag").distinct().join(found, "frag", "left").select("frag", F.coalesce("root", "frag").alias("root"))
    frozen = merge.frozen(edges, 127.5).withColumnsRenamed({"node": "frag", "root": "part"})
    placed = cut(own.join(frozen, "frag", "left").select("frag", "root", F.coalesce("part", "frag").alias("part")))
    across = placed.groupBy("root").agg(F.countDistinct("part").alias("n")).agg(F.count_if(F.col("n") > 1).alias("across"))
    parts = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("frag") == F.col("root")).alias("kept"))
    told = parts.agg(F.sum("n").alias("fragments"), F.sum(F.when((F.col("n") == 1) & (F.col("kept") == 1), 1).otherwise(0)).cast("long").alias("alone"))
    return _count(merge.violations(edges, found, 127.5)).join(across, F.lit(True)).join(told, F.lit(True))


_PROPOSALS = "SELECT l_partkey AS blue, l_suppkey AS red, max(l_orderkey) AS pri, count(*) AS add, 20 AS size FROM lineitem GROUP BY 1, 2"


@query(
    "parhac_accept",
    f"""WITH p AS ({_PROPOSALS}), w AS (SELECT *, coalesce(sum(add) OVER (PARTITION BY red ORDER BY pri DESC, blue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM p)
SELECT blue AS frag, red AS root FROM w WHERE so_far <= greatest(round(size * 0.4), 1)""",
)
def _(spark, sf_dir):
    rows = L.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("blue"), F.col("l_suppkey").alias("red")).agg(F.max("l_orderkey").alias("pri"), F.count("*").alias("add"))
    return merge.accept(rows.withColumn("size", F.lit(20)), 0.4)


@query(
    "best_proposal",
    """WITH e AS (SELECT l_suppkey + 1 AS u, l_partkey + 1000000 AS v, sum(CAST(round(l_discount * 100) * 25 AS BIGINT)) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2),
p AS (SELECT CASE WHEN u % 2 = 1 THEN u ELSE v END AS red, CASE WHEN u % 2 = 1 THEN v ELSE u END AS blue FROM e WHERE s / n >= 100 AND u % 2 <> v % 2),
k AS (SELECT *, (blue * 31 + red * 17) % 1009 AS pri FROM p WHERE red % 7 <> 0 AND red % 3 >= blue % 3)
SELECT blue, max((pri, red))[2] AS red, max(pri) AS pri, 1 + blue % 3 AS add, 1 + max((pri, red))[2] % 3 AS size FROM k GROUP BY blue""",
)
def _(spark, sf_dir):
    contacts = L.lineitem_contacts(spark, sf_dir)
    edges = cut(graph.contract_rows(contacts.select("u", "v", F.col("aff").cast("long").alias("sum_bytes"), F.lit(1).cast("long").alias("cnt"))))
    ids = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    nodes = ids.select("id", (F.col("id") % 3 + 1).alias("size"), (F.col("id") % 7 == 0).alias("frozen"))
    return merge.propose(edges, nodes, 100, lambda node: node % 2, lambda blue, red: (blue * 31 + red * 17) % 1009)


@query("cluster_sizes", f"{_BLOCK_GRAPH} SELECT frag - frag % 4 AS root, count(*) AS size FROM (SELECT DISTINCT unnest([u, v]) AS frag FROM rag) GROUP BY 1")
def _(spark, sf_dir):
    up = cut(_by_fours(spark, sf_dir)[1])
    return merge.grown(up.select(F.col("frag").alias("id"), F.lit(1).cast("long").alias("size")), up).withColumnRenamed("id", "root")


@query("overgrown", "SELECT l_suppkey AS id FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_linenumber <= 3) > 0 AND count(*) > 1.4 * count(*) FILTER (WHERE l_linenumber <= 3)")
def _(spark, sf_dir):
    rows = L.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), "l_linenumber")
    size = lambda df: df.groupBy("id").agg(F.count("*").alias("size"))
    return merge.overgrown(size(rows), size(rows.where("l_linenumber <= 3")), 0.4)


@query("pointer_jump", "SELECT o_orderkey AS node, o_orderkey % 2 AS parent FROM (SELECT DISTINCT o_orderkey FROM orders)")
def _(spark, sf_dir):
    keys = L.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node")).distinct()
    extra = keys.sparkSession.range(2).select(F.col("id").alias("node"))
    up = keys.select("node", F.when(F.col("node") < 2, F.col("node")).when(F.col("node") % 4 < 2, F.col("node") % 2).otherwise(F.col("node") - 2).alias("parent"))
    both = up.unionByName(extra.join(keys, "node", "left_anti").select("node", F.col("node").alias("parent")))
    return components.compress(both).join(keys, "node", "left_semi")


@query("extract_labels", f"{_W}, {_BLOCKS} SELECT vox, frag - frag % 4 AS label FROM fr")
def _(spark, sf_dir):
    _, _, frags = _blocks(spark, sf_dir)
    up = frags.select("frag").distinct().select("frag", (F.col("frag") - F.col("frag") % 4).alias("root"))
    return labels.extract(frags, up)


@query("n_labels", f"{_W}, {_BLOCKS} SELECT count(DISTINCT CASE WHEN frag <> 0 THEN frag END) AS n_labels FROM fr")
def _(spark, sf_dir):
    return labels.n_labels(_blocks(spark, sf_dir)[2].select("vox", F.col("frag").alias("label")))


# -- metrics ---------------------------------------------------------------------------

_PAIRS = "p AS (SELECT l_partkey % 16 AS seg, l_suppkey % 8 AS gt FROM lineitem WHERE l_suppkey % 8 <> 0), c AS (SELECT seg, gt, count(*) AS n FROM p GROUP BY 1, 2), s AS (SELECT seg, sum(n) AS n FROM c GROUP BY 1), t AS (SELECT gt, sum(n) AS n FROM c GROUP BY 1), tot AS (SELECT sum(n) AS n FROM c)"


@query("contingency", f"WITH {_PAIRS} SELECT seg, gt, n FROM c")
def _(spark, sf_dir):
    return metrics.contingency(L.lineitem_labels(spark, sf_dir))


@query("rand", f"WITH {_PAIRS} SELECT round((SELECT sum(n * n) FROM c) / (SELECT sum(n * n) FROM t), 9) AS rand_split, round((SELECT sum(n * n) FROM c) / (SELECT sum(n * n) FROM s), 9) AS rand_merge")
def _(spark, sf_dir):
    return metrics.evaluate(L.lineitem_labels(spark, sf_dir)).select(*(F.round(c, 9).alias(c) for c in ("rand_split", "rand_merge")))


_H = "(SELECT -sum({0}.n / tot.n * log2({0}.n / tot.n)) FROM {0}, tot)"
_VOI = f"round({_H.format('c')} - {_H.format('t')}, 9) AS voi_split, round({_H.format('c')} - {_H.format('s')}, 9) AS voi_merge"


@query("voi", f"WITH {_PAIRS} SELECT {_VOI}")
def _(spark, sf_dir):
    return metrics.evaluate(L.lineitem_labels(spark, sf_dir)).select(*(F.round(c, 9).alias(c) for c in ("voi_split", "voi_merge")))


_LIMITS = ", ".join(f"({t}, {s}, {m})" for t, (s, m) in voi_limits().items())


@query("voi_gate", f"WITH {_PAIRS}, m AS (SELECT {_VOI}), lim(threshold, most_split, most_merge) AS (VALUES {_LIMITS}) SELECT CAST(threshold AS DOUBLE) AS threshold, voi_split <= most_split AND voi_merge <= most_merge AS passes FROM m, lim")
def _(spark, sf_dir):
    limits = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.lit(s).alias("s"), F.lit(m).alias("m")) for t, (s, m) in voi_limits().items())))
    got = metrics.evaluate(L.lineitem_labels(spark, sf_dir)).select("*", limits.alias("l"))
    return got.select("l.threshold", ((F.col("voi_split") <= F.col("l.s")) & (F.col("voi_merge") <= F.col("l.m"))).alias("passes"))


# -- geometry --------------------------------------------------------------------------


def _mirror_sql(axis: int) -> str:
    name, channel, stride, extent = (("z", "az", "sz", "shape.Z"), ("y", "ay", "sy", "shape.Y"), ("x", "ax", "1", "shape.X"))[axis]
    at = {a: f"{extent} - 1 - l.{a}" if a == name else f"l.{a}" for a in "zyx"}
    value = {c: f"CASE WHEN l.{name} = {extent} - 1 THEN 0 ELSE o.{c} END" if c == channel else f"l.{c}" for c in ("az", "ay", "ax")}
    return f"""{_W}, big AS (SELECT {at['z']} AS z, {at['y']} AS y, {at['x']} AS x, {value['az']} AS az, {value['ay']} AS ay, {value['ax']} AS ax FROM shape, lat l LEFT JOIN lat o ON o.vox = l.vox + l.{stride})
SELECT (z * Y + y) * X + x AS vox, z, y, x, az, ay, ax FROM (SELECT big.*, shape.Y AS Y_, shape.X AS X_ FROM big, shape)""".replace("l.1", "1").replace("(z * Y + y) * X + x", "(z * Y_ + y) * X_ + x")


def _mirror(axis: int):
    @query(f"mirror_axis_{'zyx'[axis]}", _mirror_sql(axis))
    def _(spark, sf_dir):
        lattice, shape = L.events_lattice(spark, sf_dir)
        return geometry.mirror(lattice, shape, axis)


for _axis in range(3):
    _mirror(_axis)


def _tiled_sql() -> str:
    """Along each axis in turn: the lattice, and its mirror image behind it."""
    parts, before = [], "lat"
    for i, (name, channel, extent) in enumerate((("z", "az", "shape.Z"), ("y", "ay", "shape.Y"), ("x", "ax", "shape.X"))):
        at = ", ".join(f"2 * {extent} - 1 - l.{a} AS {a}" if a == name else f"l.{a}" for a in "zyx")
        own = ", ".join(f"CASE WHEN l.{name} = {extent} - 1 THEN 0 ELSE o.{c} END AS {c}" if c == channel else f"l.{c}" for c in ("az", "ay", "ax"))
        met = " AND ".join(f"o.{a} = l.{a} + {int(a == name)}" for a in "zyx")
        parts.append(f"t{i} AS (SELECT z, y, x, az, ay, ax FROM {before} UNION ALL SELECT {at}, {own} FROM {before} l LEFT JOIN {before} o ON {met}, shape)")
        before = f"t{i}"
    return f"{_W}, {', '.join(parts)} SELECT (t2.z * 2 * shape.Y + t2.y) * 2 * shape.X + t2.x AS vox, t2.z, t2.y, t2.x, az, ay, ax FROM t2, shape"


@query("tile_2x2x2", _tiled_sql())
def _(spark, sf_dir):
    lattice, shape = L.events_lattice(spark, sf_dir)
    return geometry.tile(lattice, shape, (2, 2, 2))[0]


@query("crop", f"{_W} SELECT ((z - 2) * 6 + y - 1) * 7 + x - 3 AS vox, z - 2 AS z, y - 1 AS y, x - 3 AS x, az, ay, ax FROM lat WHERE z BETWEEN 2 AND 6 AND y BETWEEN 1 AND 6 AND x BETWEEN 3 AND 9")
def _(spark, sf_dir):
    return geometry.crop(L.events_lattice(spark, sf_dir)[0], (2, 1, 3), (7, 7, 10))[0]


@query("tile_index", f"{_W} SELECT vox, z // 4 AS tz, y // 4 AS ty, x // 8 AS tx, (z > 0 AND z % 4 = 0) OR (y > 0 AND y % 4 = 0) OR (x > 0 AND x % 8 = 0) AS on_face FROM lat")
def _(spark, sf_dir):
    return geometry.tiles_of(L.events_lattice(spark, sf_dir)[0], (4, 4, 8))


@query("face_union", f"{_W} SELECT vox, nbr, axis, aff FROM fc")
def _(spark, sf_dir):
    return flow.faces(*L.events_lattice(spark, sf_dir))


@query("float_lattice_mean", f"WITH RECURSIVE {_lat('CAST(least(greatest(round_even(CAST(CAST(value / 600.0 AS FLOAT) * CAST(255 AS FLOAT) AS DOUBLE), 0), 0), 255) AS INTEGER)', '0', '0')} SELECT CAST(sum(az) AS BIGINT) AS total, max(az) AS most FROM lat")
def _(spark, sf_dir):
    return L.events_lattice_float(spark, sf_dir)[0].agg(F.sum("az").alias("total"), F.max("az").alias("most"))


# -- end to end ------------------------------------------------------------------------


@query("segment_events")
def _(spark, sf_dir):
    lattice, shape = L.events_lattice(spark, sf_dir)
    return segment_frames(cut(lattice), shape, [0.5])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie-free fragments, their contact graph, frozen components, labels, and how they compare with the fragments."""
    edges, frags = _shaped(spark, sf_dir)
    up = merge.frozen(edges, _CUT).withColumnRenamed("node", "frag")
    got = labels.extract(frags, up)
    found = metrics.evaluate(metrics.align(got, frags.select("vox", F.col("frag").alias("gt"))))
    # rounded, and without a negative zero
    return found.select(*(F.round(F.col(c) + 0.0, 9).alias(c) for c in found.columns))


query(
    "slice_voi",
    f"""{_SHAPED}, {_cc(f'SELECT u AS a, v AS b FROM rag WHERE sum_bytes / cnt > {_CUT}', 'SELECT DISTINCT frag AS n FROM fr WHERE frag > 0', 'part')},
p AS (SELECT coalesce(part.l, 0) AS seg, fr.frag AS gt FROM fr LEFT JOIN part ON part.n = fr.frag WHERE fr.frag > 0), c AS (SELECT seg, gt, count(*) AS n FROM p GROUP BY 1, 2),
s AS (SELECT seg, sum(n) AS n FROM c GROUP BY 1), t AS (SELECT gt, sum(n) AS n FROM c GROUP BY 1), tot AS (SELECT sum(n) AS n FROM c)
SELECT round((SELECT sum(n * n) FROM c) / (SELECT sum(n * n) FROM t), 9) AS rand_split, round((SELECT sum(n * n) FROM c) / (SELECT sum(n * n) FROM s), 9) AS rand_merge, {_VOI}""",
)(flagship)
