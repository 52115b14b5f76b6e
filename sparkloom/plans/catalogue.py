"""All registered queries of the library and their SQL for DuckDB, over the overlay of the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import checkpointed, spread
from ..operators import approx, assembly, generate, graph, market, pattern, reasoning
from ..sources import overlay, sinks
from ..streaming import partial

P = overlay.PATTERN
PRODUCT = "ECONOMY"


def _t(spark, d):
    return overlay.tables(spark, d)


def _edges(spark, d):
    return overlay.graph_edges(_t(spark, d))


def _embeddings(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")


def _relation(spark, d, label: int) -> DataFrame:
    return _embeddings(spark, d).where(F.col("label") == label).orderBy("id").limit(1).select("embedding")


def _triples(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    c = F.col
    one = lambda dst, rel: o.select(c("o_custkey").alias("src"), F.lit(rel).alias("rel"), dst.cast("long").alias("dst"))
    return one(F.ascii("o_orderstatus"), 207).union(one(F.substring("o_orderpriority", 1, 1).cast("int"), 3)).union(one(c("o_orderkey") % 97, 40))


TRIPLES_SQL = """tri AS (SELECT o_custkey AS src, 207 AS rel, CAST(ascii(o_orderstatus) AS BIGINT) AS dst FROM orders
  UNION ALL SELECT o_custkey, 3, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) FROM orders UNION ALL SELECT o_custkey, 40, o_orderkey % 97 FROM orders)"""


def _reads(spark, d) -> DataFrame:
    docs = spread(spark.read.parquet(f"{d}/documents.parquet").select("text"))
    letters = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", "")
    return docs.select(F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACTGACTGACTGACTGACTGACTGAC").alias("read"))


READS_SQL = "reads AS (SELECT translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACTGACTGACTGACTGACTGACTGAC') AS read FROM documents)"
K = 12
KMERS_SQL = READS_SQL + f", km AS (SELECT substr(read, i, {K}) AS kmer, count(*) AS n FROM (SELECT read, unnest(range(1, length(read) - {K - 2})) AS i FROM reads WHERE length(read) >= {K}) GROUP BY 1)"


def _social(spark, d) -> DataFrame:
    """People who met in a forum on one day by being next to each other there, both ways."""
    from pyspark.sql import Window

    post = overlay.posts(spark.read.parquet(f"{d}/events.parquet"))
    pairs = post.select("person", F.lead("person").over(Window.partitionBy("item").orderBy("ts", "event_id")).alias("other")).where("other IS NOT NULL AND other <> person").distinct()
    return pairs.select(F.col("person").alias("person1"), F.col("other").alias("person2")).union(pairs.select("other", "person"))


SOCIAL_SQL = """pairs AS (SELECT DISTINCT person, other FROM (SELECT person, lead(person) OVER (PARTITION BY item ORDER BY ts, event_id) AS other FROM post) WHERE other IS NOT NULL AND other <> person),
social AS (SELECT person AS person1, other AS person2 FROM pairs UNION ALL SELECT other, person FROM pairs)"""


def _uses(spark, d) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select(F.col("user_id").alias("person"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("server")).distinct()


USES_SQL = "use AS (SELECT DISTINCT user_id AS person, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS server FROM events)"


def _flows(spark, d) -> DataFrame:
    from pyspark.sql import Window

    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("src_device"))
    return events.select("src_device", F.lead("src_device").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("dst_device")).where("dst_device IS NOT NULL")


FLOWS_SQL = """flow AS (SELECT * FROM (SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS src_device,
  lead(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst_device FROM events) WHERE dst_device IS NOT NULL)"""
TRADERS_SQL = f"""mkt AS (SELECT * FROM sale WHERE product = '{PRODUCT}' AND seller <> buyer),
traders AS (SELECT id, sum(sold) AS sold, sum(bought) AS bought, sum(desired) AS desired, max(type) AS type FROM (
  SELECT seller AS id, 0.0 AS sold, amount AS bought, 0.0 AS desired, 3 AS type FROM sale WHERE product = '{PRODUCT}' AND seller = buyer
  UNION ALL SELECT seller, amount, 0, 0, 4 FROM mkt UNION ALL SELECT buyer, 0, amount, amount, 5 FROM mkt) GROUP BY id)"""


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c), digits))
    return df


def _influencers(spark, d) -> DataFrame:
    return market.traders(overlay.sale(spark, d), PRODUCT).where("sold > 0").orderBy(F.desc("sold"), "id").limit(3).select("id")


def _roots(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") + 1000000).alias("id")).distinct().where("id % 20 = 0")


def _hist(spark, d) -> DataFrame:
    return approx.histograms(_t(spark, d), P)


def _pattern_side(h: DataFrame) -> DataFrame:
    """The stated pattern: the vertices of the overlay whose ids end in 00."""
    return h.where("id % 100 = 0")


def _stream_match(spark: SparkSession, d: str) -> DataFrame:
    """The stream of events against the static purchases: the same answer as the batch operator's."""
    t = _t(spark, d)
    static = {k: v for k, v in t.items() if k not in ("post", "author", "forum_event", "has_topic")}

    def answer(records: DataFrame) -> DataFrame:
        now = dict(static)
        now["author"] = records.select("person", "item", F.lit("FORUMEVENT").alias("item_type")).unionByName(t["author"].where("item_type = 'PUBLICATION'"))
        now["forum_event"] = records.groupBy(F.col("item").alias("id"), "forum").agg(F.min("date").alias("date"))
        local = records.select(F.col("forum").alias("item")).distinct().select("item", F.lit("FORUM").alias("item_type"), F.when(F.col("item") % 2 == 0, "centre").otherwise("elsewhere").alias("topic"))
        now["has_topic"] = records.select("item", F.lit("FORUMEVENT").alias("item_type"), "topic").unionByName(local).unionByName(t["has_topic"].where("item_type = 'PUBLICATION'"))
        return pattern.partial_match(now, P)

    board = partial.Scoreboard(spark, answer)
    partial.drained(overlay.posts(partial.stream_of(spark, f"{d}/events.parquet")).select("person", "forum", "item", "date", "topic"), board)
    return board.alerts().select("person").distinct()


def _stream_distributors(spark: SparkSession, d: str) -> DataFrame:
    lines = partial.stream_of(spark, f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", F.col("l_suppkey").alias("seller"))
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("buyer"))
    part = spark.read.parquet(f"{d}/part.parquet").where(F.col("p_type") == P.ammunition).select(F.col("p_partkey").alias("l_partkey"))
    sales = lines.join(part, "l_partkey").join(orders, "l_orderkey").select("seller", "buyer")
    folder = partial.shared_folder(spark, "distributors")
    partial.drained(partial.new_distributors(sales), lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/{n:09d}"))
    return spark.read.option("recursiveFileLookup", True).schema("seller long, first_buyer long, second_buyer long").parquet(folder).select("seller").distinct()


def _stream_masks(spark: SparkSession, d: str) -> DataFrame:
    posts = overlay.posts(partial.stream_of(spark, f"{d}/events.parquet"))
    return partial.kept_latest(partial.item_masks(posts, ("click", "view", "signup", "purchase", "error")), ("item", "forum"))


def _two_hop_scores(spark, d) -> DataFrame:
    tri, e = _triples(spark, d), _embeddings(spark, d).select("id", "embedding")
    first = reasoning.top_k(reasoning.persons(tri, 207), e, _relation(spark, d, 1), _relation(spark, d, 2), 50)
    return reasoning.top_k(first.select("id"), e, _relation(spark, d, 3), _relation(spark, d, 4), 50)


def _affiliation(spark, d) -> DataFrame:
    tri, e = _triples(spark, d), _embeddings(spark, d).select("id", "embedding")
    return reasoning.best_affiliation(_two_hop_scores(spark, d), e, _relation(spark, d, 5), reasoning.universities(tri, 40))


def _nodes(spark, d) -> DataFrame:
    counts = checkpointed(assembly.kmer_counts(_reads(spark, d), K))
    return assembly.macro_nodes(counts, assembly.cutoff(counts, 21), 20.0)


def _long_reads(spark, d) -> DataFrame:
    """Error-free reads of a made-up genome of part names' digests: pieces that overlap by half."""
    parts = spark.read.parquet(f"{d}/part.parquet").where("p_partkey < 60").select("p_partkey", F.translate(F.sha2(F.col("p_partkey").cast("string"), 512), "0123456789abcdef", "ACTGACTGACTGACTG").alias("s"))
    whole = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "s"))), lambda x: x["s"]), "").alias("g"))
    return whole.select(F.explode(F.sequence(F.lit(1), F.length("g") - 199, F.lit(50))).alias("i"), "g").select(F.expr("substring(g, i, 200)").alias("read"))


def _contigs(spark, d) -> DataFrame:
    counts = checkpointed(assembly.kmer_counts(_long_reads(spark, d), 31))
    return assembly.contigs(assembly.macro_nodes(counts, 1, 4.0), checkpointed)


def queries() -> dict:
    c = F.col
    return {
        "scan_sales": lambda s, d: overlay.sale(s, d).groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seller").alias("sellers"), F.countDistinct("buyer").alias("buyers"), F.max("date").alias("last")),
        "scan_events_topics": lambda s, d: _t(s, d)["has_topic"].groupBy("item_type", "topic").agg(F.count(F.lit(1)).alias("n")),
        "purchase_class_dates": lambda s, d: pattern.class_dates(overlay.sale(s, d), P),
        "qualified_buyers": lambda s, d: pattern.qualified_buyers(overlay.sale(s, d), P),
        "distributors": lambda s, d: pattern.distributors(overlay.sale(s, d), P),
        "distributor_buyers": lambda s, d: pattern.distributor_buyers(overlay.sale(s, d), P).distinct(),
        "near_center_orgs": lambda s, d: pattern.near_topics(_t(s, d)["topic"], P),
        "item_topic_bitmask": lambda s, d: pattern.item_bitmask(_t(s, d)["has_topic"], P).select("item", c("fe4").cast("int").alias("fe4"), c("fe5").cast("int").alias("fe5"), c("jihad").cast("int").alias("jihad")),
        "forum_state": lambda s, d: pattern.forum_state(_t(s, d), P),
        "electronics_witness": lambda s, d: pattern.electronics_witness(_t(s, d), P),
        "exact_match": lambda s, d: pattern.exact_match(_t(s, d), P),
        "same_forum_repeat_authors": lambda s, d: pattern.repeat_authors(_t(s, d), P),
        "partial_match_final": lambda s, d: pattern.partial_match(_t(s, d), P),
        "partial_match_stream": _stream_match,
        "stream_distributors": _stream_distributors,
        "stream_item_masks": _stream_masks,
        "triple_histograms": _hist,
        "similarity_edges": lambda s, d: approx.similarity_edges(_pattern_side(h := checkpointed(_hist(s, d))), h, 6),
        "approx_match_k": lambda s, d: _rounded(approx.match(_pattern_side(h := checkpointed(_hist(s, d))), h, 3), "similarity"),
        "transe_top50": lambda s, d: _rounded(reasoning.top_k(reasoning.persons(_triples(s, d), 207), _embeddings(s, d).select("id", "embedding"), _relation(s, d, 1), _relation(s, d, 2)), "score", digits=4),
        "transe_two_hop": lambda s, d: _rounded(_two_hop_scores(s, d), "score", digits=4),
        "transe_affiliation": lambda s, d: _rounded(_affiliation(s, d), "score", digits=4),
        "kg_three_way": lambda s, d: reasoning.exact_three_way(_triples(s, d), 207, 70, 3, 1, 40),
        "vertex_ids": lambda s, d: graph.vertices(_edges(s, d)).select("gid", "id", "vtype"),
        "csr_offsets": lambda s, d: graph.vertices(_edges(s, d)).select("gid", "degree", "start"),
        "csr_edges": lambda s, d: graph.csr_edges(_edges(s, d)),
        "one_hop_features": lambda s, d: graph.one_hop(_edges(s, d)),
        "two_hop_features": lambda s, d: graph.two_hop(_edges(s, d)),
        "true_edges": lambda s, d: graph.true_edges(_edges(s, d)),
        "edge_split": lambda s, d: graph.edge_split(graph.true_edges(_edges(s, d))),
        "false_edges": lambda s, d: graph.false_edges(_edges(s, d)),
        "ego_graph_induced": lambda s, d: graph.ego_induced(_edges(s, d), _roots(s, d)),
        "ego_graph_sampled": lambda s, d: graph.ego_sampled(_edges(s, d), _roots(s, d)),
        "market_traders": lambda s, d: _rounded(market.traders(overlay.sale(s, d), PRODUCT), "sold", "bought", "desired", digits=2),
        "sale_weights": lambda s, d: _rounded(market.sale_weights(overlay.sale(s, d), PRODUCT), "weight"),
        "friend_weights": lambda s, d: _rounded(market.friends(_social(s, d), market.traders(overlay.sale(s, d), PRODUCT)), "weight"),
        "use_weights": lambda s, d: _rounded(market.uses(_uses(s, d), market.traders(overlay.sale(s, d), PRODUCT)), "weight"),
        "send_weights": lambda s, d: _rounded(market.sends(_flows(s, d), market.uses(_uses(s, d), market.traders(overlay.sale(s, d), PRODUCT))), "weight"),
        "market_edges_simple": lambda s, d: sinks.edge_lines(_rounded(market.simple_edges(overlay.sale(s, d), PRODUCT), "weight").withColumn("weight", F.format_number("weight", 6)), "seller", "buyer", "weight"),
        "market_edges_complex": lambda s, d: sinks.edge_lines(market.complex_edges(overlay.sale(s, d), PRODUCT).withColumn("weight", F.format_number("weight", 6)), "seller", "seller_type", "buyer", "buyer_type", "weight"),
        "market_adjusted": lambda s, d: _rounded(market.adjusted(overlay.sale(s, d), PRODUCT, _influencers(s, d)), "amount", digits=2),
        "kmer_counts": lambda s, d: assembly.kmer_counts(_reads(s, d), K),
        "kmer_count_histogram": lambda s, d: assembly.count_histogram(assembly.kmer_counts(_reads(s, d), K), 21),
        "kmer_cutoff": lambda s, d: assembly.cutoff(assembly.kmer_counts(_reads(s, d), K), 21),
        "macro_nodes": lambda s, d: _nodes(s, d).select("key", "is_prefix", "affix", "n", "visits"),
        "macro_wires": lambda s, d: assembly.macro_wires(_nodes(s, d)),
        "contigs": _contigs,
        "systematic_sample": lambda s, d: generate.systematic(s.read.parquet(f"{d}/orders.parquet"), "o_orderkey", 10).select("o_orderkey"),
        "sample_closure": lambda s, d: generate.closure(t := _t(s, d), t["sale"].where("seller % 10 = 0"), t["forum_event"].where("id % 10 = 0"))["person"],
        "type_statistics": lambda s, d: _rounded(pattern.type_statistics(_edges(s, d).select("type")), "share"),
        "pi_estimate": lambda s, d: generate.pi(s, 10_000_000),
    }


def oracle_sql() -> dict[str, str]:
    g = "WITH " + overlay.SQL
    gg = g + ", " + overlay.GRAPH_SQL
    m = g + ", " + TRADERS_SQL
    dist = "dist AS (SELECT seller FROM sale WHERE product = 'PROMO' GROUP BY seller HAVING count(DISTINCT buyer) > 1)"
    cls = f"""{dist}, cls AS (SELECT buyer, max(CASE WHEN product = 'SMALL' THEN date END) AS bb, max(CASE WHEN product = 'LARGE' THEN date END) AS pc,
      max(CASE WHEN product = 'PROMO' AND seller IN (SELECT seller FROM dist) THEN date END) AS am, max(CASE WHEN product = 'MEDIUM' THEN 1 ELSE 0 END) AS el
      FROM sale WHERE product IN ('SMALL', 'LARGE', 'PROMO', 'MEDIUM') GROUP BY buyer)"""
    qual = f"{cls}, qual AS (SELECT buyer AS person, least(bb, pc, am) AS trans_date FROM cls WHERE bb IS NOT NULL AND pc IS NOT NULL AND am IS NOT NULL AND el = 1)"
    near_sql = "close AS (SELECT id FROM topic WHERE sqrt(power((lon + 73.94) * 0.91, 2) + power((lat - 40.67) * 1.15, 2)) <= 30)"
    wit = f"""{near_sql}, wit AS (SELECT DISTINCT buyer AS person FROM sale WHERE product = 'MEDIUM' AND seller IN (
      SELECT person FROM author WHERE item_type = 'PUBLICATION' AND item IN (SELECT item FROM has_topic WHERE item_type = 'PUBLICATION' AND topic = 'engineering')
      AND item IN (SELECT publication FROM has_org WHERE organization IN (SELECT id FROM close))))"""
    mask = """mask AS (SELECT item, bit_or(CASE topic WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 4 ELSE 0 END) AS fe4,
      bit_or(CASE topic WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END) AS fe5, max(CASE WHEN topic = 'error' THEN 1 ELSE 0 END) AS jihad FROM has_topic WHERE item_type = 'FORUMEVENT' GROUP BY item)"""
    state = f"""{mask}, fs AS (SELECT forum, bool_or(fe4 = 7) AS fe4, bool_or(fe5 = 3) AS fe5, forum % 2 = 0 AS nyc, CAST(sum(jihad) AS BIGINT) AS jihad,
      min(CASE WHEN fe4 = 7 THEN date END) AS fe4_date FROM mask JOIN forum_event ON item = id GROUP BY forum)"""
    exact = f"""{qual}, {wit}, {state}, pf AS (SELECT DISTINCT person, forum FROM post)
      SELECT q.person FROM qual q WHERE q.person IN (SELECT person FROM wit) AND EXISTS (SELECT 1 FROM pf JOIN fs USING (forum) WHERE pf.person = q.person AND nyc AND jihad > 1)
      AND EXISTS (SELECT 1 FROM pf JOIN fs USING (forum) WHERE pf.person = q.person AND fe4 AND fe5 AND fe4_date < q.trans_date)"""
    rep = "rep AS (SELECT person, forum, count(DISTINCT item) AS n FROM post WHERE topic_error GROUP BY person, forum HAVING count(DISTINCT item) >= 2)".replace("topic_error", "item IN (SELECT item FROM post WHERE topic = 'error')")
    part = f"""{dist}, {wit}, {mask}, {rep},
      b AS (SELECT buyer AS person, bit_or(CASE product WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'PROMO' THEN 4 ELSE 8 END) AS m, max(date) AS last FROM sale
        WHERE product IN ('SMALL', 'LARGE', 'MEDIUM') OR (product = 'PROMO' AND seller IN (SELECT seller FROM dist)) GROUP BY buyer HAVING m = 15),
      f AS (SELECT forum, min(date) AS first FROM mask JOIN forum_event ON item = id WHERE fe4 = 7 OR fe5 = 3 GROUP BY forum HAVING bool_or(fe4 = 7) AND bool_or(fe5 = 3)),
      r AS (SELECT DISTINCT person FROM rep WHERE forum % 2 = 0 AND forum IN (SELECT forum FROM post WHERE topic = 'error' GROUP BY forum HAVING count(*) > 1)),
      w AS (SELECT person, min(first) AS first FROM (SELECT DISTINCT person, forum FROM post) JOIN f USING (forum) GROUP BY person)
      SELECT b.person FROM b JOIN w USING (person) WHERE person IN (SELECT person FROM wit) AND person IN (SELECT person FROM r) AND w.first < b.last"""
    kinds = ("SALE", "PURCHASE", "AUTHOR", "WRITTENBY", "INCLUDES", "INCLUDEDIN", "HASTOPIC", "TOPICIN", "HASORG", "ORGIN")
    verts = ("PERSON", "FORUM", "FORUMEVENT", "PUBLICATION", "TOPIC")
    bins = ", ".join([f"count(*) FILTER (type = '{k}') AS f{i}" for i, k in enumerate(kinds)] + [f"count(*) FILTER (dst_type = '{k}') AS f{10 + i}" for i, k in enumerate(verts)])
    one = f"one AS (SELECT src AS id, {bins} FROM edges GROUP BY src)"
    vert = """v AS (SELECT row_number() OVER (ORDER BY id) - 1 AS gid, id, vtype, degree, CAST(sum(degree) OVER (ORDER BY id) - degree AS BIGINT) AS start FROM (
      SELECT id, min(vt) AS vtype, CAST(sum(d) AS BIGINT) AS degree FROM (SELECT src AS id, src_type AS vt, 1 AS d FROM edges UNION ALL SELECT dst, dst_type, 0 FROM edges) GROUP BY id))"""
    true = "te AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst)"
    hist_rows = []
    for first, col in ((0, "seller"), (4, "buyer")):
        hist_rows.append(f"SELECT 'PERSON' AS vtype, {col} AS id, {first} + CASE product WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'PROMO' THEN 2 ELSE 3 END AS bin FROM sale WHERE product IN ('SMALL', 'LARGE', 'PROMO', 'MEDIUM')")
    hist_rows += [
        "SELECT 'PERSON', person, CASE item_type WHEN 'FORUMEVENT' THEN 8 ELSE 9 END FROM author",
        "SELECT 'FORUM', forum, 10 FROM forum_event",
        "SELECT 'FORUM', item, 11 FROM has_topic WHERE item_type = 'FORUM' AND topic = 'centre'",
        "SELECT 'FORUMEVENT', item, CASE topic WHEN 'click' THEN 12 WHEN 'view' THEN 13 WHEN 'signup' THEN 14 WHEN 'purchase' THEN 15 ELSE 16 END FROM has_topic WHERE item_type = 'FORUMEVENT'",
        "SELECT 'PUBLICATION', publication, 18 FROM has_org WHERE organization IN (SELECT id FROM close)",
        "SELECT 'PUBLICATION', item, 19 FROM has_topic WHERE item_type = 'PUBLICATION' AND topic = 'engineering'",
    ]
    hist = f"{near_sql}, hr AS ({' UNION ALL '.join(hist_rows)}), hist AS (SELECT vtype, id, {', '.join(f'count(*) FILTER (bin = {i}) AS h{i}' for i in range(20))} FROM hr GROUP BY vtype, id)"
    p, h = [f"p.h{i}" for i in range(20)], [f"h.h{i}" for i in range(20)]
    dot = lambda a, b: "(" + " + ".join(f"CAST({x} AS DOUBLE) * {y}" for x, y in zip(a, b, strict=True)) + ")"
    low = "(" + " + ".join(f"power(least({x}, {y}), 2)" for x, y in zip(p, h, strict=True)) + ")"
    sim = f"sim AS (SELECT h.vtype, p.id AS lhs, h.id AS rhs, sqrt({low}) * {dot(p, h)} / nullif(sqrt({dot(p, p)}) * sqrt({dot(h, h)}), 0) AS similarity FROM hist h JOIN hist p ON h.vtype = p.vtype WHERE p.id % 100 = 0)"
    emb = "e AS (SELECT vec_id AS id, embedding, label FROM embeddings)"
    rel = lambda n, k: f"{n} AS (SELECT embedding FROM e WHERE label = {k} ORDER BY id LIMIT 1)"
    score = lambda hh, r, t: f"(1 - list_sum(list_transform(range(1, len({hh}) + 1), lambda i: abs(CAST({hh}[i] AS DOUBLE) + {r}[i] - {t}[i]))))"
    chain = f"""WITH {TRIPLES_SQL}, {emb}, {rel('r1', 1)}, {rel('r2', 2)}, {rel('r3', 3)}, {rel('r4', 4)}, {rel('r5', 5)},
      a AS (SELECT p.id, coalesce({score('e.embedding', 'r1.embedding', 'r2.embedding')}, -3.4028234663852886e38) AS score FROM (SELECT DISTINCT src AS id FROM tri WHERE rel = 207) p LEFT JOIN e ON e.id = p.id, r1, r2 ORDER BY score DESC, id LIMIT 50),
      b AS (SELECT a.id, coalesce({score('e.embedding', 'r3.embedding', 'r4.embedding')}, -3.4028234663852886e38) AS score FROM a LEFT JOIN e ON e.id = a.id, r3, r4),
      u AS (SELECT DISTINCT dst AS place FROM tri WHERE rel = 40),
      c AS (SELECT b.id, u.place, {score('x.embedding', 'r5.embedding', 'y.embedding')} AS score FROM b JOIN e x ON x.id = b.id, u JOIN e y ON y.id = u.place, r5)"""
    km = f"WITH {KMERS_SQL}"
    least = "hh AS (SELECT i.i AS n, count(kmer) AS kmers FROM (SELECT unnest(range(1, 21)) AS i) i LEFT JOIN km ON km.n = i.i GROUP BY 1), cut AS (SELECT n AS cutoff FROM hh ORDER BY kmers, n LIMIT 1)"
    nodes = f"{km}, {least}, mn AS (SELECT substr(kmer, 1, {K - 1}) AS key, false AS is_prefix, substr(kmer, {K}, 1) AS affix, n, CAST(ceil(n / 20.0) AS BIGINT) AS visits FROM km, cut WHERE n >= cutoff UNION ALL SELECT substr(kmer, 2), true, substr(kmer, 1, 1), n, CAST(ceil(n / 20.0) AS BIGINT) FROM km, cut WHERE n >= cutoff)"
    code = "translate(affix, 'ACTG', '0123')"
    wires = f"""{nodes}, tot AS (SELECT key, CAST(sum(CASE WHEN is_prefix THEN visits ELSE 0 END) AS BIGINT) AS p, CAST(sum(CASE WHEN is_prefix THEN 0 ELSE visits END) AS BIGINT) AS s FROM mn GROUP BY key),
      al AS (SELECT * FROM mn UNION ALL SELECT key, true, '', 1, greatest(s - p, 0) FROM tot UNION ALL SELECT key, false, '', 1, greatest(p - s, 0) FROM tot),
      o AS (SELECT *, CAST(sum(visits) OVER (PARTITION BY key, is_prefix ORDER BY visits DESC, n DESC, length(affix) DESC, {code} DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM al)
      SELECT a.key, a.affix AS prefix, b.affix AS suffix, greatest(a.upto - a.visits, b.upto - b.visits) - (b.upto - b.visits) AS "offset", least(a.upto, b.upto) - greatest(a.upto - a.visits, b.upto - b.visits) AS visits
      FROM o a JOIN o b ON a.key = b.key AND a.is_prefix AND NOT b.is_prefix WHERE least(a.upto, b.upto) > greatest(a.upto - a.visits, b.upto - b.visits)"""
    weight = "(SELECT seller, buyer, date, amount, amount / sum(amount) OVER (PARTITION BY seller) AS weight FROM mkt)"
    return {
        "scan_sales": g + " SELECT product, count(*) AS n, count(DISTINCT seller) AS sellers, count(DISTINCT buyer) AS buyers, max(date) AS last FROM sale GROUP BY product",
        "scan_events_topics": g + " SELECT item_type, topic, count(*) AS n FROM has_topic GROUP BY ALL",
        "purchase_class_dates": g + f", {cls} SELECT * FROM cls",
        "qualified_buyers": g + f", {qual} SELECT * FROM qual",
        "distributors": g + f", {dist} SELECT * FROM dist",
        "distributor_buyers": g + f", {dist} SELECT DISTINCT buyer, date FROM sale WHERE product = 'PROMO' AND seller IN (SELECT seller FROM dist)",
        "near_center_orgs": g + f", {near_sql} SELECT id FROM close",
        "item_topic_bitmask": g + f", {mask} SELECT item, CAST(fe4 AS INT) AS fe4, CAST(fe5 AS INT) AS fe5, CAST(jihad AS INT) AS jihad FROM mask",
        "forum_state": g + f", {state} SELECT * FROM fs",
        "electronics_witness": g + f", {wit} SELECT * FROM wit",
        "exact_match": g + f", {exact}",
        "same_forum_repeat_authors": g + f", rep AS (SELECT person, forum, count(*) AS n FROM (SELECT DISTINCT person, item, forum FROM post WHERE item IN (SELECT item FROM post WHERE topic = 'error')) GROUP BY person, forum HAVING count(*) >= 2) SELECT * FROM rep",
        "partial_match_final": g + f", {part}",
        "partial_match_stream": g + f", {part}",
        "stream_distributors": g + f", {dist} SELECT * FROM dist",
        "stream_item_masks": g + " SELECT item, forum, bit_or(CASE topic WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 4 WHEN 'purchase' THEN 8 ELSE 16 END) AS mask, count(*) AS n, min(date) AS first FROM post GROUP BY item, forum",
        "triple_histograms": g + f", {hist} SELECT * FROM hist",
        "similarity_edges": g + f", {hist}, {sim} SELECT vtype, lhs, rhs, round(similarity, 6) AS similarity FROM sim WHERE similarity > 0",
        "transe_top50": chain + " SELECT id, round(score, 4) AS score FROM a",
        "transe_two_hop": chain + " SELECT id, round(score, 4) AS score FROM b",
        "transe_affiliation": chain + " SELECT id, place, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, place) AS n FROM c) WHERE n = 1",
        "kg_three_way": f"WITH {TRIPLES_SQL} SELECT DISTINCT p.src AS id, p.dst AS place FROM tri a JOIN tri w ON a.src = w.src JOIN tri p ON p.src = a.src WHERE a.rel = 207 AND a.dst = 70 AND w.rel = 3 AND w.dst = 1 AND p.rel = 40",
        "vertex_ids": gg + f", {vert} SELECT gid, id, vtype FROM v",
        "csr_offsets": gg + f", {vert} SELECT gid, degree, start FROM v",
        "csr_edges": gg + f", {vert} SELECT a.start + row_number() OVER (PARTITION BY a.gid ORDER BY b.gid, type) - 1 AS pos, a.gid AS src_gid, b.gid AS dst_gid, type FROM edges JOIN v a ON src = a.id JOIN v b ON dst = b.id",
        "one_hop_features": gg + f", {one} SELECT * FROM one",
        "two_hop_features": gg + f", {one} SELECT src AS id, {', '.join(f'CAST(sum(f{i}) AS BIGINT) AS g{i}' for i in range(15))} FROM edges JOIN one ON dst = one.id GROUP BY src",
        "true_edges": gg + f", {true} SELECT * FROM te",
        "edge_split": gg + f", {true}, s AS (SELECT *, CAST(('0x' || substr(md5(a || '-' || b), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM te) SELECT a, b, CASE WHEN u < 0.85 THEN 'train' WHEN u < 0.85 + 0.05 THEN 'validate' ELSE 'test' END AS part FROM s",
        "false_edges": gg + f", {vert}, {true}, n AS (SELECT count(*) AS n FROM v) SELECT DISTINCT least(v.id, w.id) AS a, greatest(v.id, w.id) AS b FROM v, n JOIN v w ON w.gid = (v.gid * 7919 + 104729 + 1) % n.n WHERE v.id <> w.id AND NOT EXISTS (SELECT 1 FROM te WHERE te.a = least(v.id, w.id) AND te.b = greatest(v.id, w.id))",
        "market_traders": m + " SELECT id, round(sold, 2) AS sold, round(bought, 2) AS bought, round(desired, 2) AS desired, type FROM traders",
        "sale_weights": m + f" SELECT seller, buyer, date, amount, round(weight, 6) AS weight FROM {weight}",
        "friend_weights": m + f", {SOCIAL_SQL}, i AS (SELECT * FROM social WHERE person1 IN (SELECT id FROM traders) AND person2 IN (SELECT id FROM traders)) SELECT person1, person2, round(1.0::DOUBLE / count(*) OVER (PARTITION BY person1), 6) AS weight FROM i",
        "use_weights": m + f", {USES_SQL} SELECT person, server, round(1.0::DOUBLE / count(*) OVER (PARTITION BY person), 6) AS weight FROM use WHERE person IN (SELECT id FROM traders)",
        "send_weights": m + f", {USES_SQL}, {FLOWS_SQL}, sv AS (SELECT DISTINCT server FROM use WHERE person IN (SELECT id FROM traders)), i AS (SELECT src_device, dst_device, count(*) AS n FROM flow WHERE src_device IN (SELECT server FROM sv) AND dst_device IN (SELECT server FROM sv) GROUP BY ALL) SELECT src_device, dst_device, round(n::DOUBLE / sum(n) OVER (PARTITION BY src_device), 6) AS weight FROM i",
        "market_edges_simple": m + f" SELECT seller || ' ' || buyer || ' ' || printf('%.6f', round(weight, 6)) AS value FROM {weight}",
        "market_edges_complex": m + f" SELECT seller || ' ' || a.type || ' ' || buyer || ' ' || b.type || ' ' || printf('%.6f', round(weight, 6)) AS value FROM {weight} JOIN traders a ON a.id = seller JOIN traders b ON b.id = buyer",
        "kmer_counts": km + " SELECT kmer, n FROM km",
        "kmer_count_histogram": km + " SELECT i.i AS n, count(kmer) AS kmers FROM (SELECT unnest(range(1, 21)) AS i) i LEFT JOIN km ON km.n = i.i GROUP BY 1",
        "kmer_cutoff": f"{km}, {least} SELECT cutoff FROM cut",
        "macro_nodes": nodes + " SELECT * FROM mn",
        "macro_wires": wires,
        "systematic_sample": "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n % 10 = 0",
        "sample_closure": g + " SELECT DISTINCT id FROM (SELECT seller AS id FROM sale WHERE seller % 10 = 0 UNION ALL SELECT buyer FROM sale WHERE seller % 10 = 0 UNION ALL SELECT person FROM author WHERE item_type = 'FORUMEVENT' AND item IN (SELECT id FROM forum_event WHERE id % 10 = 0))",
        "type_statistics": gg + " SELECT type, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM edges GROUP BY type",
    }
