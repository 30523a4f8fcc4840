"""An inverted index in blocks, and top-k retrieval that leaves out blocks which can't matter.

Documents are dealt into ranges of about RANGE of them by a hash of their ids. A block holds the postings of one token in
one range, with their number, the largest frequency and the smallest length: together a bound of what any of them can add
to a score, whatever the averages are. A batch of queries is answered in steps. The rarest tokens of each query, as long
as their postings are few, give seeds, and the k-th best whole score of these is a threshold. Tokens that even together
can't reach it are not essential: documents that have no others are no candidates. The essential tokens' postings are read
in ranges whose bounds can reach the threshold, and the other tokens' only for candidates that still can. Scores are those
of the exhaustive sum.

An index is a folder of segments. append() adds one, with ranges of its own; merge() writes all of them as one when there
are many. Counts and lengths are summed up over segments when a search begins, so scores are those of one corpus.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillet.functions.text import tokens
from quillet.sources.held import held, scratch

RANGE = 128
#: Tokens are read for a query's threshold, the rarest first, while they have so many postings together; one at least.
RARE_POSTINGS = 4000
#: So many times top_k documents are scored whole to find a query's threshold.
SEEDS = 4
MERGE_AT = 8
#: Up to so many distinct tokens of queries are looked up in the scan itself.
FEW = 4096
#: So many documents are a task's work, about, when blocks are made.
TASK_ROWS = 4096
BLOCK_COLUMNS = ["token", "rng", "n", "tf_max", "dl_min", "postings"]


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table in one row group is scanned by one task, however dear the expressions on it are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, token, times: a token that a query repeats counts as often."""
    return queries.select("qid", F.explode(tokens("query")).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("times"))


def part(times: Column, idf: Column, tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    """What one token adds to a score."""
    norm = F.lit(1 - b) + F.lit(b) * dl / F.greatest(avgdl, F.lit(1.0))
    return times * idf * tf * (k1 + 1) / (tf + F.lit(k1) * norm)


class Index:
    """Postings of a corpus (id, ord, text) under path, or under a new path of the shared folder; see the module."""

    def __init__(self, corpus: DataFrame | None = None, path: str | None = None, spark: SparkSession | None = None, range_rows: int = RANGE):
        self.spark, self.range_rows = spark or corpus.sparkSession, range_rows
        self.path = (path or scratch(self.spark, "postings")).rstrip("/")
        if corpus is not None:
            self.append(corpus)

    def names(self) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(x.getPath().toString() for x in fs.listStatus(p)) if fs.exists(p) else []

    def whole(self) -> list[str]:
        """The folders of segments that are written completely and not merged into another."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = p(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        ready = [n for n in self.names() if fs.exists(p(f"{n}/totals/_SUCCESS"))]
        gone = {r.name for n in ready if fs.exists(p(f"{n}/merged/_SUCCESS")) for r in self.spark.read.parquet(f"{n}/merged").collect()}  # MERGE_AT names
        return [n for n in ready if n.rsplit("/", 1)[1] not in gone]

    def append(self, corpus: DataFrame) -> None:
        """Add a segment of new documents; totals are written last, so half a segment never counts."""
        n, name = corpus.count(), uuid.uuid4().hex[:12]
        home = f"{self.path}/segments/{name}"
        self.made(corpus, n, name).sortWithinPartitions("token", "rng").write.parquet(f"{home}/blocks")
        length = self.spark.read.parquet(f"{home}/blocks").select(F.explode("postings.tf").alias("tf")).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
        length.select(F.lit(n).cast("long").alias("n"), "total").write.parquet(f"{home}/totals")
        if len(self.whole()) >= MERGE_AT:
            self.merge()

    def made(self, corpus: DataFrame, n: int, name: str) -> DataFrame:
        """The blocks of n new documents."""
        rng = F.concat(F.lit(f"{name}-"), F.pmod(F.xxhash64(F.col("id")), F.lit(max(1, -(-n // self.range_rows)))).cast("string"))
        # texts are dealt by ranges once; counts, blocks and their order are made where they lie
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))
        docs = corpus.select("id", "ord", rng.alias("rng"), F.coalesce("text", F.lit("")).alias("text")).repartition(parts, "rng")
        docs = docs.select("id", "ord", "rng", tokens("text").alias("tokens")).withColumn("dl", F.size("tokens"))
        each = docs.select("id", "ord", "dl", "rng", F.explode("tokens").alias("token")).groupBy("token", "rng", "id", "ord", "dl").agg(F.count("*").alias("tf"))
        posting = F.struct("id", "ord", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"))
        return each.groupBy("token", "rng").agg(F.count("*").alias("n"), F.max("tf").alias("tf_max"), F.min("dl").alias("dl_min"), F.collect_list(posting).alias("postings"))

    def merge(self) -> None:
        """All segments as one: blocks stay as they are, sorted together. What is merged counts until the new one is whole."""
        old, name = self.whole(), uuid.uuid4().hex[:12]
        if len(old) < 2:
            return
        home = f"{self.path}/segments/{name}"
        self.blocks(old).repartitionByRange("token", "rng").sortWithinPartitions("token", "rng").write.parquet(f"{home}/blocks")
        self.spark.createDataFrame([(n.rsplit("/", 1)[1],) for n in old], "name string").write.parquet(f"{home}/merged")
        self.spark.read.parquet(*[f"{n}/totals" for n in old]).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).coalesce(1).write.parquet(f"{home}/totals")

    def blocks(self, segments: list[str] | None = None) -> DataFrame:
        return self.spark.read.parquet(*[f"{n}/blocks" for n in segments or self.whole()]).select(*BLOCK_COLUMNS)

    def totals(self) -> tuple[int, float]:
        """The number of documents and their mean length."""
        r = self.spark.read.parquet(*[f"{n}/totals" for n in self.whole()]).agg(F.sum("n").alias("n"), F.sum("total").alias("t")).first()
        return r.n, r.t / max(1, r.n)

    def of(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All postings (token, id, ord, tf, dl) of the wanted tokens, and the totals as a row: for scores of everything."""
        n, avgdl = self.totals()
        found = self.blocks().join(wanted, "token", "left_semi").select("token", F.explode("postings").alias("p"))
        return found.select("token", "p.id", "p.ord", "p.tf", "p.dl"), self.spark.range(1).select(F.lit(n).alias("n"), F.lit(float(avgdl)).alias("avgdl"))

    def search_plan(self, queries: DataFrame, top_k: int, k1: float, b: float) -> dict[str, DataFrame]:
        """The steps of a search, each written: see scores()."""
        n, avgdl = self.totals()
        avgdl = F.lit(float(avgdl))
        terms = held(query_terms(queries), "terms")
        few = [r.token for r in terms.select("token").distinct().limit(FEW + 1).collect()]
        blocks = self.blocks() if len(few) > FEW else self.blocks().where(F.col("token").isin(*few) if few else F.lit(False))
        bounds = held(blocks.select("token", "rng", "n", "tf_max", "dl_min").join(terms.select("token").distinct(), "token", "left_semi"), "bounds")
        # a token's bound over all ranges, too: it parts essential tokens from others
        most = part(F.lit(1), F.lit(1.0), F.col("tf_max"), F.col("dl_min"), avgdl, k1, b)
        each = bounds.groupBy("token").agg(F.sum("n").alias("df"), F.max(most).alias("top"))
        idf = F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weighed = held(terms.join(each, "token").select("qid", "token", "times", "df", idf.alias("idf"), (F.col("times") * idf * F.col("top")).alias("top")), "weighed")

        w = Window.partitionBy("qid").orderBy("df", "token")
        rare = weighed.withColumns({"so_far": F.sum("df").over(w), "at": F.row_number().over(w)}).where(f"so_far <= {RARE_POSTINGS} or at = 1")
        some = score(rare, blocks, avgdl, k1, b).groupBy("qid", "id", "rng").agg(F.sum("part").alias("part"))
        at = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("part"), "id"))
        seeds = held(some.withColumn("at", at).where(F.col("at") <= SEEDS * top_k).select("qid", "id", "rng"), "seeds")
        full = of_documents(weighed, seeds, blocks, avgdl, k1, b).groupBy("qid", "id").agg(F.sum("part").alias("part"))
        at = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("part"), "id"))
        # ranks are by four decimals, so what could be rounded up to the threshold is looked at, too
        least = full.withColumn("at", at).where(F.col("at") == top_k).select("qid", (F.col("part") - 0.0001).alias("least"))

        # tokens that even together can't reach the threshold bring in no document of their own
        up = Window.partitionBy("qid").orderBy("top", "token")
        parted = weighed.join(least, "qid", "left").withColumn("essential", F.coalesce(F.sum("top").over(up) >= F.col("least"), F.lit(True)))
        parted = held(parted, "parted")
        by_range = parted.join(bounds, "token").withColumn("most", F.col("times") * F.col("idf") * most)
        reach = by_range.groupBy("qid", "rng").agg(F.sum("most").alias("most"), F.coalesce(F.sum(F.when(~F.col("essential"), F.col("most"))), F.lit(0.0)).alias("others"), F.first("least").alias("least"))
        alive = held(reach.where("least is null or most >= least"), "alive")
        first = parted.where("essential").join(alive.select("qid", "rng"), "qid").join(bounds.select("token", "rng"), ["token", "rng"])
        begun = score(first, blocks, avgdl, k1, b).groupBy("qid", "id", "ord", "rng").agg(F.sum("part").alias("part"))
        left = held(begun.join(alive, ["qid", "rng"]).where("least is null or part + others >= least").select("qid", "id", "ord", "rng", "part"), "left")
        return {"blocks": blocks, "bounds": bounds, "parted": parted, "first": first, "left": left, "avgdl": avgdl}

    def scores(self, queries: DataFrame, top_k: int, k1: float, b: float) -> DataFrame:
        """qid, id, ord, score of every document that can be among the top_k of a query (qid, query).

        Seeds, the best documents by a query's rarest tokens, are scored whole; their k-th best score is a threshold.
        Essential tokens of ranges that can reach it bring in documents; those that can reach it with what the other
        tokens add at most in their range are scored by these, too.
        """
        p = self.search_plan(queries, top_k, k1, b)
        rest = of_documents(p["parted"].where("not essential"), p["left"].select("qid", "id", "rng"), p["blocks"], p["avgdl"], k1, b)
        both = p["left"].select("qid", "id", "ord", "part").unionByName(rest.select("qid", "id", "ord", "part"))
        return both.groupBy("qid", "id", "ord").agg(F.sum("part").alias("score"))

    def work(self, queries: DataFrame, top_k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """postings, scored: of all queries' tokens, how many postings there are, and how many an answer's scores are summed from. One row."""
        p = self.search_plan(queries, top_k, k1, b)
        all_ = p["parted"].join(p["bounds"], "token").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("postings"))
        others = p["parted"].where("not essential").join(p["left"].select("qid", "rng").distinct(), "qid")
        read = [x.join(p["bounds"], ["token", "rng"]).select("n") for x in (p["first"].select("token", "rng"), others.select("token", "rng"))]
        return all_.crossJoin(read[0].unionByName(read[1]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scored")))  # one row each


def score(wanted: DataFrame, blocks: DataFrame, avgdl: Column, k1: float, b: float) -> DataFrame:
    """qid, id, ord, rng, part of each posting of the wanted (qid, token, times, idf; and rng if it has it)."""
    by = ["token", "rng"] if "rng" in wanted.columns else ["token"]
    hits = wanted.select("qid", *by, "times", "idf").join(blocks.select("token", "rng", "postings"), by).select("qid", "rng", "times", "idf", F.explode("postings").alias("p"))
    return hits.select("qid", "rng", "p.id", "p.ord", part(F.col("times"), F.col("idf"), F.col("p.tf"), F.col("p.dl"), avgdl, k1, b).alias("part"))


def of_documents(terms: DataFrame, docs: DataFrame, blocks: DataFrame, avgdl: Column, k1: float, b: float) -> DataFrame:
    """The parts of score() for some documents (qid, id, rng): their ranges' blocks of each query's terms are read, and filtered as they are."""
    ranges = docs.groupBy("qid", "rng").agg(F.collect_set("id").alias("ids"))  # RANGE documents at most, about
    wanted = terms.select("qid", "token", "times", "idf").join(ranges, "qid")
    own = F.filter("postings", lambda p: F.array_contains("ids", p["id"]))
    hits = wanted.join(blocks.select("token", "rng", "postings"), ["token", "rng"]).select("qid", "rng", "times", "idf", F.explode(own).alias("p"))
    return hits.select("qid", "rng", "p.id", "p.ord", part(F.col("times"), F.col("idf"), F.col("p.tf"), F.col("p.dl"), avgdl, k1, b).alias("part"))
