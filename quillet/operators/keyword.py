"""BM25 over an inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions.text import tokens
from quillet.operators.postings import FEW, Index, part, query_terms, spread
from quillet.sources.held import held

K1, B = 1.5, 0.75
#: So many tokens of queries are sent to the tasks that score documents, and so many queries and documents are multiplied at once.
FEW_TERMS, QUERIES, DOCS = 1 << 20, 512, 512


def totals(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"), (F.sum("dl") / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))


def found(corpus: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of the wanted tokens, and the totals, of a corpus without an index: its texts are tokenised once.

    wanted: the tokens of some queries; if there are more than FEW, an index is built.
    """
    few = some_tokens(wanted)
    if len(few) > FEW:
        return Index(corpus).of(wanted)
    hit = hits(corpus, few)
    tf = hit.select("id", "ord", "dl", F.explode("tokens").alias("token")).groupBy("token", "id", "ord", "dl").agg(F.count("*").alias("tf"))
    return tf, totals(hit)


def some_tokens(wanted: DataFrame) -> list[str]:
    """FEW tokens, and one more if there are more."""
    return [r.token for r in wanted.limit(FEW + 1).collect()]


def hits(corpus: DataFrame, few: list[str]) -> DataFrame:
    """id, ord, dl, tokens of all documents, written: a few tokens alone, repeats kept."""
    docs = spread(corpus.select("id", "ord", "text")).select("id", "ord", tokens(F.coalesce("text", F.lit(""))).alias("tokens")).withColumn("dl", F.size("tokens"))
    return held(docs.select("id", "ord", "dl", F.filter("tokens", lambda t: t.isin(*few) if few else F.lit(False)).alias("tokens")), "hits")


def scores(corpus: DataFrame | Index, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """qid, id, ord, score of every row of corpus (id, ord, text; or its index) that shares a token with a query (qid, query).

    Only postings of the queries' tokens leave the scan. Scores that aren't positive go.
    """
    terms = query_terms(queries)
    wanted = terms.select("token").distinct()
    postings, total = corpus.of(wanted) if isinstance(corpus, Index) else found(corpus, wanted)
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    weighed = terms.join(df, "token").crossJoin(total)  # total is one row
    weighed = weighed.select("qid", "token", "times", "avgdl", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    return ranked_sum(postings.join(weighed, "token"), k1, b)


def ranked_sum(hits: DataFrame, k1: float, b: float) -> DataFrame:
    each = part(F.col("times"), F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return hits.groupBy("qid", "id", "ord").agg(F.sum(each).alias("score")).where("score > 0")


def best(corpus: DataFrame, queries: DataFrame, top_k: int, k1: float, b: float) -> DataFrame:
    """scores() of the rows that can be among the top_k of a query.

    Documents are scored where they lie, by a product of their tokens' weights with the queries', and top_k of each batch
    leave it: what is shuffled grows with batches times queries, not with the postings that queries meet.
    """
    terms = held(query_terms(queries), "terms")
    few = some_tokens(terms.select("token").distinct())
    if len(few) > FEW:
        return Index(corpus).scores(queries, top_k, k1, b)
    if terms.count() > FEW_TERMS:
        return scores(corpus, queries, k1, b)
    hit = hits(corpus, few)
    df = hit.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    n, avgdl = totals(hit).first()
    weight = F.col("times") * F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    asked = terms.join(df, "token").select("qid", "token", weight.alias("weight")).toArrow()  # FEW_TERMS at most
    qids = asked.column("qid").combine_chunks().dictionary_encode(null_encoding="encode")
    words = asked.column("token").combine_chunks().dictionary_encode()
    query, qids, word, words = qids.indices.to_numpy(), qids.dictionary, words.indices.to_numpy(), words.dictionary
    weights = asked.column("weight").to_numpy()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, DOCS):
                batch = whole.slice(a, DOCS)
                x = document_weights(batch, words, avgdl, k1, b)
                order = np.empty(batch.num_rows, np.int64)
                order[pc.sort_indices(batch.column("ord"), null_placement="at_start").to_numpy()] = np.arange(batch.num_rows)
                for q in range(0, len(qids), QUERIES):
                    here = (query >= q) & (query < q + QUERIES)
                    y = np.zeros((len(words), min(QUERIES, len(qids) - q)))
                    y[word[here], query[here] - q] = weights[here]
                    rows, found, sums = top_of(x @ y, order, top_k)
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(found + q)), batch.column("id").take(pa.array(rows)), batch.column("ord").take(pa.array(rows)), pa.array(sums)], names=["qid", "id", "ord", "score"])

    kinds = {"qid": terms, "id": hit, "ord": hit}
    return hit.select("id", "ord", "dl", "tokens").mapInArrow(score, ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c, df in kinds.items()) + ", score double")


def document_weights(batch: pa.RecordBatch, words: pa.Array, avgdl: float, k1: float, b: float) -> np.ndarray:
    """Documents x words: what each word's weight in a query is multiplied with. Of (dl, tokens)."""
    lists = batch.column("tokens")
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    at = pc.index_in(lists.flatten(), words).to_numpy(zero_copy_only=False)
    tf = np.bincount(row * len(words) + at.astype(np.int64), minlength=len(lists) * len(words)).reshape(len(lists), len(words))
    norm = 1 - b + b * batch.column("dl").to_numpy() / max(avgdl, 1.0)
    return tf * (k1 + 1) / np.maximum(tf + k1 * norm[:, None], 1e-300)


def rounded(scores: np.ndarray) -> np.ndarray:
    """Scores in units of 0.0001 as SQL rounds them: halves of the shortest decimal go up."""
    units = scores * 10_000
    whole = np.floor(units)
    out = whole + (units - whole >= 0.5)
    for at in np.argwhere(np.abs(units - whole - 0.5) < 1e-6):
        out[tuple(at)] = int((Decimal(repr(float(scores[tuple(at)]))) * 10_000).to_integral_value(ROUND_HALF_UP))
    return out


def top_of(scores: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and scores of the k best rows of each column that are above 0: by the rounded score, ties by order."""
    key, n = rounded(scores), min(max(k, 1), len(scores))
    near = (key >= np.partition(key, len(key) - n, 0)[len(key) - n]) & (scores > 0)
    for c in np.flatnonzero(near.sum(0) > n):
        tied = np.flatnonzero(near[:, c])
        near[tied[np.lexsort((order[tied], -key[tied, c]))[n:]], c] = False
    rows, columns = np.nonzero(near)
    return rows, columns, scores[rows, columns]


def search(corpus: DataFrame | Index, queries: DataFrame, top_k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """qid, id, ord, score (4 decimals), rank from 0; ranked on the rounded score, ties in the corpus's order.

    With an index, blocks of postings that can't reach a query's top_k aren't read. Without one, see best().
    """
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "ord")
    found = (corpus.scores(queries, top_k, k1, b) if isinstance(corpus, Index) else best(corpus, queries, top_k, k1, b)).withColumn("score", F.round("score", 4)).where("score > 0")
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top_k).withColumn("rank", F.col("rn") - 1).drop("rn")


def fuse(lists: list[tuple[DataFrame, float]], k: int = 60, key: Column | str = "id") -> DataFrame:
    """id, score, best (list number and rank of its first place): reciprocal rank fusion of lists (id, rank), each with its weight."""
    one = [df.select("id", (F.lit(w) / (F.lit(k + 1) + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("list"), F.col("rank").alias("rank")).alias("place")) for i, (df, w) in enumerate(lists)]
    both = one[0]
    for x in one[1:]:
        both = both.unionByName(x)
    return both.groupBy("id").agg(F.sum("part").alias("score"), F.min("place").alias("best"), F.min(F.when(F.col("place.list") == 0, F.col("place.rank"))).alias("rank0"), F.min(F.when(F.col("place.list") == 1, F.col("place.rank"))).alias("rank1"))


def hybrid(vectors: DataFrame, corpus: DataFrame, vector: list[float] | DataFrame, text: str, top_k: int = 5, weight: float = 0.6, vector_threshold: float = 0.2, bm25_corpus_limit: int | None = None) -> DataFrame:
    """id, score, vector_rank, bm25_rank: 2 x top_k by vector at vector_threshold and by BM25, fused; ties: vector list first.

    bm25_corpus_limit: only the first rows by ord are searched by words (None: all).
    """
    from quillet.operators.similarity import topk

    spark = vectors.sparkSession
    near = topk(vectors, vector, 2 * top_k, vector_threshold)
    near = near.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")) - 1)
    rows = corpus if bm25_corpus_limit is None else corpus.orderBy("ord").limit(bm25_corpus_limit)
    words = search(rows, spark.createDataFrame([(0, text)], "qid int, query string"), 2 * top_k)
    fused = fuse([(near, weight), (words, 1 - weight)])
    top = fused.orderBy(F.desc(F.round("score", 12)), "best", "id").limit(top_k)
    return top.select("id", F.round("score", 4).alias("score"), F.col("rank0").alias("vector_rank"), F.col("rank1").alias("bm25_rank"))
