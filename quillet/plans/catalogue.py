"""The named queries of the engine and their DuckDB equivalents.

Each query reads the tables under sf_dir, whole, and gives one DataFrame. Thresholds and reference times are arguments of
the operators; the values here suit the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.engine import Engine
from quillet.functions import entities, projection, quality, segment, text, ttl
from quillet.functions.vectors import embed
from quillet.operators import context, dedup, graph, keyword, lifecycle, mailbox, maintenance, similarity, store, vector_index
from quillet.plans import sql
from quillet.schema import memories_from_documents, messages_from_events
from quillet.sources import snapshots
from quillet.sources.held import held, scratch
from quillet.streaming import timers
from quillet.streaming.ingest import activity, counts, distinct_texts, ingest, into_engine, live_messages

NOW_TEXT, MAIL_NOW_TEXT = "timestamp'2025-01-15 00:00:00'", "timestamp'2024-01-20 00:00:00'"
EDGE = 0.4
PHRASE = "licensed under the apache license version 2.0 released public mit"
PATTERNS = {"version": r"version (\d+\.?\d*)", "ratio": r"(\d+\.\d+)", "number": r"\b(\d{2,4})\b"}

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):
    """Register f under its name, and the SQL of that name if there is one."""
    QUERIES[f.__name__] = f
    if f.__name__ in sql.SQL:
        ORACLE_SQL[f.__name__] = sql.SQL[f.__name__]
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), "embedding", "label", F.col("label").cast("string").alias("tags"))


def memories(spark, d) -> DataFrame:
    return memories_from_documents(table(spark, d, "documents"))


def corpus(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), "text")


def messages(spark, d) -> DataFrame:
    return messages_from_events(table(spark, d, "events"))


def query_vector(spark, d) -> DataFrame:
    """The vector of row 0: one row, q."""
    return vectors(spark, d).where("id = 0").select(F.col("embedding").alias("q")).limit(1)


def short_time(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# -- vectors ------------------------------------------------------------------


@query
def vector_topk(spark, d):
    return similarity.topk(vectors(spark, d), query_vector(spark, d), 5, 0.3)


@query
def vector_topk_filtered(spark, d):
    return similarity.topk(vectors(spark, d), query_vector(spark, d), 10, 0.1, F.col("label") == 3)


@query
def vector_threshold(spark, d):
    return similarity.pairs(vectors(spark, d), 0.3).select("a", "b", F.round("sim", 4).alias("similarity"))


@query
def knn_batch(spark, d):
    v = vectors(spark, d)
    found = similarity.knn(v.where("id % 20 = 0"), v, 5)
    return found.select("query_id", "id", "rank", F.round("sim", 4).alias("similarity"))


@query
def rerank_two_stage(spark, d):
    return similarity.rerank(vectors(spark, d), query_vector(spark, d), 3, 10, 0.2)


@query
def vector_threshold_cells(spark, d):
    """vector_threshold with blocks small enough to be clustered and pruned."""
    return similarity.pairs(vectors(spark, d), 0.3, block=100).select("a", "b", F.round("sim", 4).alias("similarity"))


@query
def knn_cells(spark, d):
    """knn_batch in two rounds over clustered blocks."""
    v = vectors(spark, d)
    found = similarity.knn(v.where("id % 20 = 0"), v, 5, block=100)
    return found.select("query_id", "id", "rank", F.round("sim", 4).alias("similarity"))


@query
def knn_index(spark, d):
    """knn_batch by an index: as many cells probed and candidates rescored as these scattered vectors need; similarities are exact."""
    v = vectors(spark, d)
    index = vector_index.VectorIndex.build(v, scratch(spark, "index"))
    probes, refine = index.calibrated(v, 5, probes=max(1, len(index.centres) * 2 // 3), refine=100)
    found = index.search(v.where("id % 20 = 0"), 5, probes=probes, refine=refine)
    return found.select("query_id", "id", "rank", F.round("sim", 4).alias("similarity"))


@query
def index_recall(spark, d):
    """How many queries there are, and whether the index finds nine tenths of their five nearest rows at least."""
    v = vectors(spark, d)
    q = v.where("id % 20 = 0")
    exact = similarity.knn(q, v, 5).select("query_id", "id")
    found = knn_index(spark, d).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "id"], "left").agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_ok"))


@query
def search_all(spark, d):
    v, q = vectors(spark, d), query_vector(spark, d)
    active = similarity.topk(v.where("id % 2 = 0"), q, 5, 0.2).withColumn("state", F.lit("active"))
    archived = similarity.topk(v.where("id % 2 = 1"), q, 5, 0.2).withColumn("state", F.lit("archived"))
    return active.unionByName(archived)


# -- gate and tokens ----------------------------------------------------------


@query
def quality_gate(spark, d):
    layer = quality.reject_layer("text")
    return memories(spark, d).select("id", layer.alias("layer"), layer.isNull().alias("accepted"))


@query
def quality_gate_counts(spark, d):
    return memories(spark, d).groupBy(F.coalesce(quality.reject_layer("text"), F.lit("accepted")).alias("layer")).agg(F.count("*").alias("n"))


@query
def tokenize_counts(spark, d):
    t = text.tokens("text")
    return corpus(spark, d).select("id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query
def doc_freq(spark, d):
    t = corpus(spark, d).select("id", F.explode(F.array_distinct(text.tokens("text"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("df"))


@query
def term_freq(spark, d):
    t = corpus(spark, d).select("id", F.explode(text.tokens("text")).alias("token"))
    return t.groupBy("id", "token").agg(F.count("*").alias("tf"))


# -- keyword and hybrid search ------------------------------------------------


def phrase(spark) -> DataFrame:
    return spark.createDataFrame([(0, PHRASE)], "qid bigint, query string")


@query
def bm25_topk(spark, d):
    return keyword.search(corpus(spark, d), phrase(spark), 10).select("id", "score", "rank")


@query
def bm25_batch(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return keyword.search(corpus(spark, d), q, 3).select("qid", "id", "score", "rank")


@query
def hybrid_rrf(spark, d):
    v = vectors(spark, d).join(corpus(spark, d).select("id"), "id", "left_semi")
    return keyword.hybrid(v, corpus(spark, d), query_vector(spark, d), PHRASE, 5)


# -- graph --------------------------------------------------------------------


def similarity_graph(spark, d) -> DataFrame:
    return graph.edges(vectors(spark, d), EDGE)


@query
def sim_edges(spark, d):
    return similarity_graph(spark, d)


@query
def degree(spark, d):
    return graph.degrees(similarity_graph(spark, d))


@query
def hubs(spark, d):
    return graph.hubs(similarity_graph(spark, d))


@query
def graph_stats(spark, d):
    return graph.stats(vectors(spark, d), similarity_graph(spark, d))


@query
def components(spark, d):
    return graph.clusters(similarity_graph(spark, d), vectors(spark, d).select("id", "ord"))


@query
def cluster_summary(spark, d):
    g, v = held(similarity_graph(spark, d), "edges"), vectors(spark, d)
    s = graph.summaries(v, g, graph.clusters(g, v.select("id", "ord")))
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return s.select("cluster", "size", F.array_join(F.transform("top_hubs", lambda x: x.cast("string")), ",").alias("top_hubs"), tags.alias("tags"))


@query
def node_table(spark, d):
    g, v = held(similarity_graph(spark, d), "edges"), vectors(spark, d)
    n = v.select("id", "ord", "tags").join(graph.degrees(g), "id", "left").join(graph.clusters(g, v.select("id", "ord")), "id", "left")
    return n.select("id", "tags", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("cluster", F.lit("")).alias("cluster"))


@query
def neighbors_1hop(spark, d):
    return graph.neighbours(similarity_graph(spark, d), vectors(spark, d).where("id % 20 = 0").select("id"), 1)


@query
def neighbors_2hop(spark, d):
    g = held(similarity_graph(spark, d), "edges")
    return graph.neighbours(g, vectors(spark, d).where("id % 20 = 0").select("id"), 2)


@query
def guided_search(spark, d):
    g, v, c = held(similarity_graph(spark, d), "edges"), vectors(spark, d), corpus(spark, d)
    base = keyword.hybrid(v.join(c.select("id"), "id", "left_semi"), c, query_vector(spark, d), PHRASE, 10)
    from pyspark.sql import Window

    order = Window.orderBy(F.desc("score"), F.col("vector_rank").asc_nulls_last(), "bm25_rank", "id")
    base = base.select("id", "score", (F.row_number().over(order) - 1).alias("rank"))
    return graph.guided(base, c, g, graph.clusters(g, v.select("id", "ord")), PHRASE, 5)


# -- dedup --------------------------------------------------------------------


@query
def keyword_jaccard(spark, d):
    k = corpus(spark, d).select("id", text.keywords("text").alias("k"))
    nxt = k.select((F.col("id") - 1).alias("id"), F.col("k").alias("k2"))
    return k.join(nxt, "id").select("id", F.size("k").alias("n_keywords"), F.round(text.overlap("k", "k2"), 4).alias("shared"))


@query
def dedup_tiers_static(spark, d):
    rows = corpus(spark, d).join(vectors(spark, d).select("id", "embedding"), "id")
    return dedup.static_tiers(rows.where("id % 20 = 0"), rows, recall=0.1, least=0.02, skip=0.35, merge=0.25)


@query
def write_batch(spark, d):
    c = corpus(spark, d)
    return dedup.write_batch(c.join(embed(c, dims=512), "id"))


@query
def learnt_neighbours(spark, d):
    """The nearest documents by an embedder learnt from the documents."""
    c = held(projection.counted(corpus(spark, d), 1 << 12), "buckets")
    v = held(projection.Projection.learn(c, dims=64, buckets=1 << 12, rounds=3).embed(c), "learnt")
    found = similarity.knn(v.where("id % 20 = 0"), v, 3)
    return found.select("query_id", "id", "rank", F.round("sim", 3).alias("similarity"))


@query
def write_tiers(spark, d):
    """write_batch on the given vectors, with thresholds that suit them."""
    rows = corpus(spark, d).join(vectors(spark, d).select("id", "embedding"), "id")
    return dedup.write_batch(rows, recall=0.1, least=0.02, skip=0.3, merge=0.25)


@query
def duplicate_sweep(spark, d):
    c = corpus(spark, d)
    return maintenance.duplicate_sweep(c.join(embed(c, dims=512), "id"))


# -- lifecycle ----------------------------------------------------------------


@query
def ttl_assign(spark, d):
    return memories(spark, d).select("id", ttl.ttl_of("tags").alias("ttl"), short_time("expire_at").alias("expire_at"))


@query
def ttl_histogram(spark, d):
    return store.ttl_counts(memories(spark, d))


@query
def archive_preview(spark, d):
    p = lifecycle.preview(memories(spark, d), F.expr(NOW_TEXT))
    return p.select("would_archive", "kept", F.array_join("examples", "|").alias("examples"))


@query
def archive_split(spark, d):
    return lifecycle.split(memories(spark, d), F.expr(NOW_TEXT)).select("id", "state", short_time("archived_at").alias("archived_at"))


@query
def restore_ids(spark, d):
    ids = memories(spark, d).where("ord % 3 = 0").select("id")
    return lifecycle.restore(lifecycle.split(memories(spark, d), F.expr(NOW_TEXT)), ids).select("id", "state", short_time("archived_at").alias("archived_at"))


@query
def backfill_ttl(spark, d):
    b = store.backfill_ttl(memories(spark, d))
    return b.select("id", "ttl_days", short_time("expire_at").alias("expire_at"))


@query
def backfill_meta(spark, d):
    m = memories(spark, d).select("id", F.when(F.col("ord") % 4 != 0, F.col("source")).alias("source"), F.when(F.col("ord") % 6 != 0, F.col("created_at")).alias("created_at"), F.when(F.col("ord") % 9 != 0, F.lit(1)).alias("merged_count"))
    return store.backfill_metadata(m, F.expr(NOW_TEXT)).select("id", "source", short_time("created_at").alias("created_at"), "merged_count")


# -- store --------------------------------------------------------------------


@query
def stats(spark, d):
    return store.overview(memories(spark, d)).select("total_memories", "missing_ttl", "missing_expire", short_time("oldest").alias("oldest"), short_time("newest").alias("newest"))


@query
def tag_dist(spark, d):
    return store.tag_counts(memories(spark, d))


@query
def source_dist(spark, d):
    return store.source_counts(memories(spark, d))


@query
def list_page(spark, d):
    return store.page(memories(spark, d), 25, 50)[1].select("id", "ord", "source")


@query
def update_merge(spark, d):
    m = memories(spark, d).select("id", "ord", F.create_map(F.lit("a"), F.col("source"), F.lit("b"), F.lit("old")).alias("extra"))
    patch = m.where("ord % 3 = 0").select("id", F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.lit("1")).alias("set"), F.array(F.lit("a")).alias("drop"))
    u = store.update(m, patch)
    return u.select("id", F.col("extra")["a"].alias("a"), F.col("extra")["b"].alias("b"), F.col("extra")["c"].alias("c"))


@query
def delete_ids(spark, d):
    m = memories(spark, d)
    return store.delete(m, m.where("ord % 7 = 0").select("id"))[1].groupBy("source").agg(F.count("*").alias("n"))


@query
def chat_cleanup(spark, d):
    return store.without_chat(memories(spark, d)).agg(F.count("*").alias("n"))


@query
def export_json(spark, d):
    items = snapshots.export_items(memories(spark, d))
    return snapshots.restored(items, "-restored").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# -- maintenance --------------------------------------------------------------


@query
def numeric_facts(spark, d):
    f = maintenance.numeric_facts(corpus(spark, d), PATTERNS)
    return f.groupBy("id", "attr").agg(F.count("*").alias("n"), F.max("value").alias("largest"), F.min("raw").alias("first_raw"))


@query
def numeric_conflicts(spark, d):
    m = memories(spark, d).select(F.col("ord").alias("id"), "ord", "text", F.col("source").alias("entity"), F.col("created_at").alias("ts"))
    c = maintenance.conflicts(m, PATTERNS)
    return c.select("entity", "attr", "values", "keep", "n_drop")


@query
def stale_count(spark, d):
    return maintenance.stale_count(memories(spark, d), F.expr(NOW_TEXT), 200)


@query
def conflict_count(spark, d):
    entity = "array(named_struct('text', source, 'label', 'organization'), named_struct('text', concat('p', cast(ord % 10 as string)), 'label', 'person'))"
    return maintenance.conflict_count(memories(spark, d).select("text", F.expr(entity).alias("entities")))


@query
def audit_pairs(spark, d):
    return maintenance.audit(vectors(spark, d), 0.35, 0.4, 0.45)


@query
def audit_nearest(spark, d):
    return maintenance.audit_nearest(vectors(spark, d), query_vector(spark, d), 100, 0.3, 0.35, 0.4)


@query
def review_page(spark, d):
    m = memories(spark, d).withColumn("needs_review", F.when(F.col("ord") % 6 != 0, F.col("ord") % 4 == 0))
    total, rows = store.page(m, 20, 10, needs_review=True)
    return rows.select("id", "ord", F.lit(total).cast("long").alias("total"))


@query
def parsed_metadata(spark, d):
    """Tags from JSON and from comma lists, entities from their text form, of every document."""
    docs = table(spark, d, "documents")
    raw = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array("source", "lang"))).otherwise(F.concat_ws(" , ", "source", F.lit(""), "lang"))
    names = F.concat_ws("|", F.concat_ws(":", "source", "lang", F.lit("organization")), "lang", F.lit(""))
    x = docs.select("doc_id", text.parse_tags(raw).alias("t"), text.parse_entities(names).alias("e"))
    return x.select("doc_id", F.array_join("t", "/").alias("tags"), text.format_entities("e").alias("entities"))


@query
def review_pairs(spark, d):
    m = corpus(spark, d).select("id", "text", (F.col("id") % 10 == 0).alias("needs_review"), (F.col("id") + 1).alias("review_similar_to"))
    return maintenance.review_pairs(m)


@query
def latency_summary(spark, d):
    return maintenance.summary(table(spark, d, "events"), "value").select("n", F.round("avg", 4).alias("avg"), F.round("p50", 4).alias("p50"), F.round("max", 4).alias("max"))


# -- conversations ------------------------------------------------------------


def turns(spark, d) -> DataFrame:
    return table(spark, d, "conversations")


@query
def turn_pairs(spark, d):
    return context.turn_pairs(turns(spark, d))


@query
def turn_memories(spark, d):
    return context.turn_memories(turns(spark, d)).select("conv_id", "turn", "text", F.array_join("tags", ",").alias("tags"))


@query
def trivial_turns(spark, d):
    return turns(spark, d).select("role", F.coalesce(context.trivial(context.without_blocks("text")), F.lit(False)).alias("trivial")).groupBy("role", "trivial").agg(F.count("*").alias("n"))


@query
def strip_context(spark, d):
    wrapped = F.concat(F.lit("<memory-context>\nold\n</memory-context> "), F.coalesce("text", F.lit("")), F.lit(" <session-context>x</session-context>"))
    return turns(spark, d).select("conv_id", "turn", "role", context.without_blocks(wrapped).alias("cleaned"))


@query
def session_tail(spark, d):
    return context.session_tail(turns(spark, d))


@query
def context_block(spark, d):
    from pyspark.sql import Window

    near = similarity.rerank(vectors(spark, d), query_vector(spark, d), 5, 10, 0.2)
    near = near.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")) - 1)
    m = memories(spark, d).select(F.col("ord").alias("id"), "text", "tags", "created_at")
    return context.context_block(near.join(m, "id"))


# -- mailbox ------------------------------------------------------------------


@query
def mailbox_list(spark, d):
    return mailbox.listed(messages(spark, d), F.expr(MAIL_NOW_TEXT), status="unread").select("id", "box", short_time("ts").alias("ts"))


@query
def mailbox_next_unread(spark, d):
    return mailbox.next_unread(messages(spark, d), F.expr(MAIL_NOW_TEXT)).select("box", "id", short_time("ts").alias("ts"))


@query
def mailbox_ack(spark, d):
    m = messages(spark, d)
    first = mailbox.next_unread(m, F.expr(MAIL_NOW_TEXT)).select("id")
    return mailbox.marked(m, first, "acked").groupBy("status").agg(F.count("*").alias("n"))


@query
def mailbox_cleanup(spark, d):
    return mailbox.cleanup_counts(messages(spark, d), F.expr(MAIL_NOW_TEXT))


@query
def mailbox_stats(spark, d):
    return mailbox.stats(messages(spark, d))


@query
def mailbox_sent(spark, d):
    """A message for each event to its user's box, and one for each kind of event to all."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("box"), F.lit("events").alias("sender"), F.col("event_type").alias("subject"), F.concat_ws(" ", F.col("event_id").cast("string"), "props").alias("body"))
    to_all = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).select(F.lit(mailbox.GLOBAL_BOX).alias("box"), F.lit("events").alias("sender"), F.col("event_type").alias("subject"), F.concat(F.col("n").cast("string"), F.lit(" events")).alias("body"))
    return mailbox.sent(e.unionByName(to_all), F.expr(MAIL_NOW_TEXT)).select("id", "box", "subject", short_time("ts").alias("ts"), "status", "ttl_hours", "priority")


@query
def mailbox_removed(spark, d):
    m = messages(spark, d)
    return mailbox.removed(m, m.where("id % 3 = 0").select("id")).groupBy("box", "status").agg(F.count("*").alias("n"))


# -- streaming ----------------------------------------------------------------


@query
def stream_ingest(spark, d):
    schema = table(spark, d, "events").schema
    folder = scratch(spark, "stream")
    out = f"{folder}-messages"
    kind = "id bigint, box bigint, ts timestamp, status string, ttl_hours int"
    stream = messages_from_events(spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet"))
    ingest(stream, lambda b: b.write.mode("append").parquet(out), f"{folder}-checkpoint", every=None).awaitTermination()
    return spark.read.schema(kind).parquet(out).groupBy("status").agg(F.count("*").alias("n"), F.sum("ttl_hours").alias("hours"))


@query
def stream_enrich(spark, d):
    """Documents as a stream, their entities added in the micro-batch that writes them."""
    docs = table(spark, d, "documents")
    folder = scratch(spark, "stream")
    out = f"{folder}-enriched"
    stream = spark.readStream.schema(docs.schema).parquet(f"{d}/document[s].parquet").select("doc_id", "text")
    ingest(stream, lambda b: b.write.mode("append").parquet(out), f"{folder}-checkpoint", every=None, enrich=entities.enriched).awaitTermination()
    rows = spark.read.schema(f"doc_id bigint, text string, entities {entities.ENTITIES}").parquet(out)
    return rows.select("doc_id", F.explode("entities").alias("e")).groupBy("e.label").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query
def stream_live(spark, d):
    """Messages of a stream that haven't expired, by status."""
    events = table(spark, d, "events")
    folder = scratch(spark, "stream")
    out = f"{folder}-live"
    stream = live_messages(messages_from_events(spark.readStream.schema(events.schema).parquet(f"{d}/event[s].parquet")), F.expr(MAIL_NOW_TEXT))
    ingest(stream, lambda b: b.write.mode("append").parquet(out), f"{folder}-checkpoint", every=None).awaitTermination()
    return spark.read.schema("id bigint, box bigint, ts timestamp, status string, ttl_hours int").parquet(out).groupBy("status").agg(F.count("*").alias("n"))


@query
def message_windows(spark, d):
    return counts(messages(spark, d)).select(short_time("window_start").alias("window_start"), "status", "n")


def streamed(spark, d, name: str, how, kind: str, number: str = "stream") -> DataFrame:
    """The rows that a stream of a table gives, `how` made of it, in append mode, and then stops."""
    home = scratch(spark, number)
    stream = spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name[:-1]}[{name[-1]}].parquet")
    how(stream).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kind).parquet(f"{home}/out")


@query
def stream_windows(spark, d):
    """Sliding windows of messages that the watermark has closed."""
    rows = streamed(spark, d, "events", lambda s: counts(messages_from_events(s), "2 days", "1 day", "1 day"), "window_start timestamp, window_end timestamp, status string, n bigint")
    return rows.select(short_time("window_start").alias("window_start"), short_time("window_end").alias("window_end"), "status", "n")


@query
def stream_sessions(spark, d):
    """Sessions of activity by box that the watermark has closed."""
    rows = streamed(spark, d, "events", lambda s: activity(messages_from_events(s), "30 minutes", "1 hour"), "box bigint, first_ts timestamp, ends_at timestamp, n bigint")
    return rows.select("box", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("ends_at").alias("ends_us"), "n")


@query
def stream_expired(spark, d):
    """Messages that timers expire."""
    rows = streamed(spark, d, "events", lambda s: timers.expired_messages(messages_from_events(s)), "id bigint, box bigint, status string, expires_ms bigint")
    return rows.select("id", "box", "status", "expires_ms")


@query
def stream_distinct(spark, d):
    """Texts of a stream of documents that pass the gate, each once."""
    timed = lambda s: distinct_texts(s.select("text", F.lit("2025-01-15 00:00:00").cast("timestamp").alias("ts")))
    return streamed(spark, d, "documents", lambda s: timed(s).select(F.sha2("text", 256).alias("text_sha256"), F.length("text").alias("chars")), "text_sha256 string, chars int")


@query
def stream_rebuilds(spark, d):
    """When what is derived from each kind of event is built anew, at most once in six hours."""
    changes = lambda s: s.select(F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("ts"))
    return streamed(spark, d, "events", lambda s: timers.rebuilds(changes(s), 6 * 3_600_000), "name string, first_ms bigint, due_ms bigint, changes bigint")


@query
def stream_write(spark, d):
    """Documents as a stream into an engine's table, through the gate and the tiers, each once."""
    home = scratch(spark, "stream")
    engine = Engine(spark, f"{home}/table", embedder=lambda t: embed(t, dims=256, idf=False))
    docs = table(spark, d, "documents")
    stream = spark.readStream.schema(docs.schema).parquet(f"{d}/document[s].parquet")
    rows = stream.select("text", "source", F.array().cast("array<string>").alias("tags"), F.col("doc_id").alias("place"), F.lit("2025-01-15 00:00:00").cast("timestamp").alias("ts"))
    into_engine(rows, engine, f"{home}/checkpoint", "documents", every=None, extract=False).awaitTermination()
    return engine.memories().select("ord", "source", "needs_review", F.length("text").alias("chars"))


# -- chains of operators --------------------------------------------------------


@query
def lookup_ids(spark, d):
    m = memories(spark, d)
    return store.by_ids(m, m.where("ord % 11 = 0").select("id")).select("id", "source")


@query
def stats_full(spark, d):
    as_text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return store.stats(memories(spark, d)).select("total_memories", "missing_ttl", "missing_expire", as_text("tag_distribution").alias("tags"), as_text("source_distribution").alias("sources"))


@query
def stale_rows(spark, d):
    m = memories(spark, d)
    return maintenance.stale_rows(m, F.expr(NOW_TEXT), 200, m.where("ord % 7 = 0").select("id")).select("id")


@query
def stored_rows(spark, d):
    rows = corpus(spark, d).join(vectors(spark, d).select("id", "embedding"), "id")
    fates = dedup.static_tiers(rows.where("id % 20 = 0"), rows, recall=0.1, least=0.02, skip=0.35, merge=0.25)
    batch = rows.join(memories(spark, d).select(F.col("ord").alias("id"), "source", "tags"), "id")
    new = dedup.stored_rows(batch, fates, F.expr(NOW_TEXT))
    return new.select("id", "ttl_days", short_time("expire_at").alias("expire_at"), "needs_review", "review_similar_to", F.round("review_similarity", 4).alias("review_similarity"))


@query
def ttl_job(spark, d):
    return lifecycle.ttl_job(memories(spark, d), F.expr(NOW_TEXT), execute=True).groupBy("state", "ttl_days").agg(F.count("*").alias("n"))


def with_entity(spark, d) -> DataFrame:
    m = memories(spark, d).select(F.col("ord").alias("id"), "ord", "text", F.col("source").alias("entity"), F.col("created_at").alias("ts"))
    return m.withColumns({"needs_review": F.col("id") % 10 == 0, "review_similar_to": F.when(F.col("id") % 10 == 0, F.col("id") + 1)})


@query
def conflict_drops(spark, d):
    return maintenance.conflict_drops(with_entity(spark, d), PATTERNS)


@query
def review_apply(spark, d):
    return maintenance.reviewed(with_entity(spark, d)).select("id", "needs_review", "review_similar_to")


@query
def nightly_deletes(spark, d):
    drops, left = maintenance.nightly(with_entity(spark, d), PATTERNS)
    return drops.withColumn("what", F.lit("drop")).unionByName(left.select("id", F.lit("stay").alias("what")))


@query
def session_end_rows(spark, d):
    return context.session_memories(turns(spark, d)).select("conv_id", "text", F.array_join("tags", ",").alias("tags"))


@query
def mirror_writes(spark, d):
    writes = table(spark, d, "documents").select(F.expr("element_at(array('add', 'replace', 'remove'), cast(doc_id % 3 as int) + 1)").alias("action"), F.lit("notes").alias("target"), F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("session_id"))
    return context.mirrored(writes).groupBy(F.array_join("tags", ",").alias("tags")).agg(F.count("*").alias("n"))


def recalled(spark, d) -> DataFrame:
    return vectors(spark, d).select("id", "embedding").join(corpus(spark, d).select("id", "text"), "id")


@query
def recall_tool(spark, d):
    result = context.recall_tool(recalled(spark, d), query_vector(spark, d), top_k=50, threshold=0.1)
    parsed = F.from_json("result", "results array<struct<id bigint, similarity double>>, count bigint")
    return result.select(parsed.alias("p")).select(F.col("p.count").alias("n"), F.array_join(F.transform("p.results", lambda r: r["id"].cast("string")), ",").alias("ids"))


@query
def preserved_facts(spark, d):
    return context.preserved_facts(recalled(spark, d), query_vector(spark, d))


@query
def hybrid_formatted(spark, d):
    v, c = vectors(spark, d).join(corpus(spark, d).select("id"), "id", "left_semi"), corpus(spark, d)
    base = keyword.hybrid(v, c, query_vector(spark, d), PHRASE, 5)
    base = base.select("id", "score", F.lit(0).alias("rank"))
    found = graph.guided(base, c, None, None, PHRASE, 5, use_cluster=False, expand=False)
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source", F.lit(None).cast("array<string>").alias("tags"))
    return graph.formatted(found, rows).select("id", "score", "method", "text", "source")


@query
def graph_cache(spark, d):
    folder = scratch(spark, "graph")
    cache, v = graph.GraphCache(spark, folder), vectors(spark, d)
    at = lambda h: F.expr(f"timestamp'2025-01-15 00:00:00' + interval {h} hours")
    edges, members = cache.load(v, at(0), EDGE)
    kept = [cache.fresh(at(h), EDGE) is not None for h in (23, 25)]
    return edges.agg(F.count("*").alias("edges")).crossJoin(members.agg(F.count_distinct("cluster").alias("clusters"))).select("*", F.lit(kept[0]).alias("after_23h"), F.lit(kept[1]).alias("after_25h"))


@query
def components_kept_up(spark, d):
    """Components after vectors went and came: every 7th goes, every 11th that had been left out comes."""
    v = vectors(spark, d).select("id", "ord", "embedding")
    cache, at = graph.GraphCache(spark, scratch(spark, "graph")), F.expr(NOW_TEXT)
    cache.write(v.where("id % 11 <> 0"), at, EDGE)
    after = v.where("id % 7 <> 0")
    cache.update(after, at + F.expr("interval 1 hour"), after.where("id % 11 = 0").select("id"), v.where("id % 7 = 0").select("id"), EDGE)
    return cache.fresh(at + F.expr("interval 2 hours"), EDGE)[1].select("id", "cluster")


@query
def bm25_index(spark, d):
    return keyword.search(keyword.Index(corpus(spark, d)), phrase(spark), 10).select("id", "score", "rank")


@query
def bm25_blocks(spark, d):
    """bm25_batch by an index of three segments, blocks that can't matter left out."""
    c = corpus(spark, d)
    index = keyword.Index(c.where("id % 3 = 0"))
    index.append(c.where("id % 3 = 1"))
    index.append(c.where("id % 3 = 2"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return keyword.search(index, q, 3).select("qid", "id", "score", "rank")


@query
def entity_extract(spark, d):
    e = corpus(spark, d).select("id", F.explode(entities.extract("text")).alias("e"))
    return e.groupBy("e.label").agg(F.count("*").alias("n"), F.count_distinct("id").alias("docs"))


@query
def keywords_segmented(spark, d):
    return corpus(spark, d).select("id", F.size(text.keywords(F.coalesce("text", F.lit("")), lambda t: F.split(t, " "))).alias("n"))


@query
def segmented_words(spark, d):
    """Words of documents cut into the parts that they are made of, by a model learnt from all of them."""
    s = segment.Segmenter.learn(table(spark, d, "documents"), script=r"\p{L}+", longest=6, rounds=2, max_words=20_000)
    return corpus(spark, d).select("id", F.size(text.runs(F.col("text"))).alias("n_runs"), F.size(text.keywords("text", s)).alias("n_keywords"))


@query
def restore_gate(spark, d):
    rows = snapshots.restored(snapshots.export_items(memories(spark, d)), "-restored")
    return rows.where(quality.worth_storing("text")).groupBy("source").agg(F.count("*").alias("n"))


@query
def snapshot_append(spark, d):
    folder = scratch(spark, "table")
    t, m = snapshots.Snapshots(spark, folder), memories(spark, d).select("id", "ord", "text", "source", "tags")
    for k in range(3):
        t.append(m.where(F.col("ord") % 3 == k))
    return t.read().groupBy("source").agg(F.count("*").alias("n"), F.count("needs_review").alias("flags"))


# -- generic operators on the other tables ------------------------------------


@query
def orders_latest(spark, d):
    """Of each customer the latest order: argmax per group."""
    o = table(spark, d, "orders")
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", -F.col("o_orderkey")))
    return o.groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@query
def customers_without_orders(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query
def pricing_rollup(spark, d):
    rows = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 4).alias("discount"))
