"""Operator 12, ranked lexical search.

``index`` shards the documents: each shard is a row that holds its documents'
ids and a compressed sparse matrix of postings (terms, where each term's
postings begin, the documents' places in the shard, integer impacts). Impacts
are precomputed, as they depend on the document and on the corpus's length
alone. A shard ends after ``SHARD_WORDS`` words, so a shard's size doesn't
depend on how many documents a partition holds; it is written and read by itself.

``search`` takes the queries in blocks of bounded size, sends a block to every
task, and scores term at a time: a dense accumulator over the shard's documents
gets each term's impacts times its weight. ``argpartition`` finds the score at
the last place; every document with that score stays in the running, so ties are
cut by id and not by chance. Tasks keep the best of their shards, tasks' best are
merged by slice and then whole.

Defined results: texts that are null or hold no term match nothing; items that
are null or hold no term have no rows; each row of the query table is an item of
its own, also where ids repeat; rows of documents with one id rank one by one,
null ids last among equal scores; fewer than the wanted rows come back where
fewer score above 0; an empty table on either side gives an empty result; other
columns are not read. A very long text is one shard; time is in proportion to it.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orograph.llm.common import SLICE_ROWS, map_rows, shared_folder, table

#: Fixed values of the ranking: parts of a document's length that count (of 100), scales of weights and impacts.
LENGTH_SHARE, SATURATION, WEIGHT_SCALE, IMPACT_SCALE = 75, 8, 1000, 1_000_000_000
BEST = 10
#: Words of a shard; queries and bytes of a block of queries; slices of tasks whose best are merged first.
SHARD_WORDS, BLOCK_QUERIES, BLOCK_BYTES, SLICES = 400_000, 5_000, 4_000_000, 64

#: Separators become spaces, A-Z their lower case; every byte of a character beyond ASCII stays.
TRANSLATED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SHARD = "task int, n_docs int, doc_ids array<long>, terms array<binary>, starts array<int>, docs binary, impacts binary"


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(TRANSLATED).split() if text else []


def corpus(docs: DataFrame, text: str = "text") -> Row:
    """N (documents with a term) and L (terms of all)."""
    lengths = map_rows(docs, lambda texts: [(len(terms(t)),) for t in texts], [], text, "n long")
    return lengths.agg(F.coalesce(F.count_if(F.col("n") > 0), F.lit(0)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()


def postings(words: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms, starts, documents (by term, then place) and frequencies of a shard."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    flat = np.fromiter((ids[w] for d in words for w in d), np.int64)
    place = np.repeat(np.arange(len(words)), [len(d) for d in words])
    pairs, often = np.unique(flat * max(1, len(words)) + place, return_counts=True)
    term, doc = np.divmod(pairs, max(1, len(words)))
    return list(ids), np.searchsorted(term, np.arange(len(ids) + 1)), doc, often


def impacts(often: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence count adds per unit of weight, in whole numbers."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * length * n_docs) // max(1, n_terms)
    return (IMPACT_SCALE * often) // (1000 * often + SATURATION * m)


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Row]:
    """Shards (``SHARD``) of all documents with a term, and the corpus's N and L."""
    whole = corpus(docs, text)
    n_docs, n_terms = whole["N"], whole["L"]

    def shard(held: list[tuple], task: int) -> pa.RecordBatch:
        words = [w for _, w in held]
        names, starts, doc, often = postings(words)
        value = impacts(often, np.array([len(w) for w in words], np.int64)[doc], n_docs, n_terms)
        columns = [[task], [len(held)], [[i for i, _ in held]], [names], [starts.astype(np.int32)], [doc.astype("<i4").tobytes()], [value.astype("<i4").tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=fields)

    types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    fields = [x.split()[0] for x in SHARD.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held, size = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if found := terms(t):
                        held.append((i, found))
                        size += len(found)
                    if size >= SHARD_WORDS:
                        yield shard(held, task)
                        held, size = [], 0
        if held:
            yield shard(held, task)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(build, SHARD), whole


def blocks(queries: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """Queries (id, Counter of terms) in blocks of bounded number and size; the driver holds one block at a time."""
    held, size = [], 0
    for item, body in queries.select(F.col(item_id).cast("long"), F.col(text).cast("string")).toLocalIterator():
        if found := Counter(terms(body)):
            held.append((item, found))
            size += sum(map(len, found))
        if len(held) >= BLOCK_QUERIES or size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def document_counts(shards: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """How many documents hold each of the ``wanted`` terms (a block's). Only terms and starts are read."""
    spark = shards.sparkSession
    known = spark.sparkContext.broadcast(wanted)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.value), np.int64)
        asked = pa.array(known.value, pa.binary())
        for batch in batches:
            for k in range(batch.num_rows):
                at = pc.index_in(asked, value_set=batch.column(0)[k].values)
                here = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                starts = batch.column(1)[k].values.to_numpy()
                row = at.fill_null(0).to_numpy()[here]
                total[here] += starts[row + 1] - starts[row]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    rows = shards.select("terms", "starts").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {wanted[r["term"]]: r["df"] for r in rows}


def best_places(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores above 0; of those equal to the last, the smallest ids."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        cut = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= cut]
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


#: Stands for a null id while ids are compared.
LAST_ID = (1 << 63) - 1


def search_block(shards: DataFrame, whole: Row, block: list[tuple], first: int, k: int) -> DataFrame:
    """(query, item_id, doc_id, score) of the best of each task, for one block of queries."""
    wanted = sorted(set().union(*(q for _, q in block)))
    df = document_counts(shards, wanted)
    place = {t: i for i, t in enumerate(wanted)}
    weight = np.array([math.floor(WEIGHT_SCALE * math.log((2 * whole["N"] + 2) / (2 * df.get(t, 0) + 1))) for t in wanted], np.int64)
    plan = [(item, np.array([place[t] for t in q], np.int64), np.array(list(q.values()), np.int64)) for item, q in block]
    known = shards.sparkSession.sparkContext.broadcast((wanted, weight, plan))
    fields = ["task", "query", "item_id", "doc_id", "score"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight, plan = known.value
        asked = pa.array(wanted, pa.binary())
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(plan)
        task = 0
        for batch in batches:
            for r in range(batch.num_rows):
                task, n, ids, names, starts, docs, value = (batch.column(c)[r] for c in range(7))
                task, n = task.as_py(), n.as_py()
                ids = ids.values.fill_null(LAST_ID).to_numpy()
                at = pc.index_in(asked, value_set=names.values).fill_null(-1).to_numpy()
                starts = starts.values.to_numpy()
                docs, value = np.frombuffer(docs.as_buffer(), "<i4"), np.frombuffer(value.as_buffer(), "<i4").astype(np.int64)
                for q, (_, used, often) in enumerate(plan):
                    score = np.zeros(n, np.int64)
                    rows = at[used]
                    for row, w in zip(rows[rows >= 0].tolist(), (weight[used] * often)[rows >= 0].tolist(), strict=True):
                        a, b = starts[row], starts[row + 1]
                        score[docs[a:b]] += w * value[a:b]
                    top = best_places(score, ids, k)
                    if len(top):
                        scores, names_ = np.concatenate([best[q][0], score[top]]), np.concatenate([best[q][1], ids[top]])
                        keep = best_places(scores, names_, k)
                        best[q] = scores[keep], names_[keep]
        many = [len(s) for s, _ in best]
        rows = [np.repeat(np.arange(len(plan)), many), np.concatenate([i for _, i in best]), np.concatenate([s for s, _ in best])]
        items = [plan[q][0] for q in rows[0].tolist()]
        columns = [pa.array(np.full(len(items), task, np.int32)), pa.array(rows[0] + first), pa.array(items, pa.int64()), pa.array([None if i == LAST_ID else i for i in rows[1].tolist()], pa.int64()), pa.array(rows[2])]
        yield pa.RecordBatch.from_arrays(columns, names=fields)

    return shards.mapInArrow(scan, "task int, query long, item_id long, doc_id long, score long")


def search(shards: DataFrame, whole: Row, queries: DataFrame, item_id: str = "item_id", text: str = "text", k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents."""
    found, first = None, 0
    for block in blocks(queries, item_id, text):
        part = search_block(shards, whole, block, first, k)
        found, first = part if found is None else found.unionByName(part), first + len(block)
    if found is None:
        return shards.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    near = found.withColumn("slice", F.pmod("task", F.lit(SLICES)))
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("query", "slice").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def written_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Row]:
    """``index`` written as Parquet to the shared folder, so that searches read the columns they need.

    A shard is a row group of its own: Parquet first looks at a group's size after a hundred rows, and readers decode a group at once,
    so that otherwise all shards of a file would be held, by writers and by readers.
    """
    spark = docs.sparkSession
    shards, whole = index(docs, doc_id, text)
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    shards.write.option("parquet.block.row.count.limit", 1).parquet(folder)
    return spark.read.parquet(folder), whole


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, whole = written_index(table(spark, sf_dir, "documents"))
    return search(shards, whole, table(spark, sf_dir, "benchmark"))


TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, unnest({TERMS.format("text")}) AS term FROM documents),
     n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
     c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
     q AS (SELECT item_id, unnest({TERMS.format("text")}) AS term FROM benchmark),
     w AS (SELECT item_id, term, count(*) AS often FROM q GROUP BY ALL),
     p AS (SELECT doc_id, term, count(*) AS tf FROM d SEMI JOIN w USING (term) GROUP BY ALL),
     f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY term),
     m AS (SELECT doc_id, 25 + (75 * n * docs) // words AS m FROM n, c),
     s AS (SELECT item_id, doc_id, CAST(sum(often * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
           FROM w JOIN p USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL),
     r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op12_lexical_search": op12_lexical_search}
ORACLE_SQL = {"op12_lexical_search": SQL}
