"""Lexical and dense retrieval, fusion, and their metrics."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import cut

K1, B = 1.5, 0.75
#: Documents and queries of one block: what one task scores at a time.
DOCUMENTS_PER_BLOCK, QUERIES_PER_BLOCK = 2048, 1024
#: Not tokens: under these ``term_counts`` has the number of texts and of all their tokens.
TEXTS, TOKENS = " texts", " tokens"
#: Rows of one Arrow batch that a block of scores is sent in.
ROWS_PER_BATCH = 1 << 16
MISS = 999


def every_twentieth(df: DataFrame, id_col: str) -> DataFrame:
    """The stated query set of a search: rows whose id, or the number at its end, is divisible by 20."""
    return df.where(F.regexp_extract(F.col(id_col).cast("string"), r"(\d+)$", 1).try_cast("bigint") % 20 == 0)


def index_text(title_path, display_title, text, title_repeat: int = 2) -> Column:
    """Title path and title, repeated, then the text."""
    title = F.concat_ws(" ", F.array_join(X.col(title_path), " "), X.col(display_title))
    return F.concat_ws(" ", *[title] * title_repeat, X.col(text))


_TOKEN = re.compile(X.TOKEN.replace(r"\x{4e00}-\x{9fff}", "\u4e00-\u9fff"))


def token_counts(text: str, normalize: bool = True) -> Counter:
    """Search tokens of a text and how often each occurs; the same tokens as functions.text.tokens gives."""
    text = (unicodedata.normalize("NFKC", text) if normalize and not text.isascii() else text).lower()
    out: Counter = Counter()
    for run in _TOKEN.findall(text):
        if run[0] >= "\u4e00":
            out.update(run)
            out.update(map("".join, zip(run, run[1:])))
        else:
            out[run] += 1
    return out


def tokenized(documents: DataFrame, id_col: str, text: Column, normalize: bool = True) -> DataFrame:
    """(id, terms, tfs, length): the distinct terms of each text and their frequencies, and how many tokens it has.

    In Python batches, because normalisation needs it and pairs of ideographs cost the JVM a scan each.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.LongType())), T.StructField("length", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [token_counts(t, normalize) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())), pa.array([c.total() for c in counts], pa.int64())],
                names=["id", "terms", "tfs", "length"])

    return rows.mapInArrow(run, schema)


def postings(tokens: DataFrame) -> DataFrame:
    """(id, length, term, tf) of what ``tokenized`` gives."""
    return tokens.select("id", "length", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("id", "length", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))


def index_statistics(tokens: DataFrame) -> DataFrame:
    """(n_docs, avg_length): one row; documents without tokens count."""
    return tokens.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))


def query_terms(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, term, idf weight): the terms of tokenised queries with what each counts by the documents ``tokens``; terms of no document are left out.

    Frequencies of all terms are counted with map-side combining, so a common term is one row when it meets the queries.
    """
    df = postings(tokens).groupBy("term").agg(F.count("*").alias("df"))
    q = postings(queries).select(F.col("id").alias("query_id"), "term", "tf").join(df, "term").crossJoin(F.broadcast(index_statistics(tokens)))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return q.select("query_id", "term", (idf * F.col("tf")).alias("weight"), "avg_length")


def term_counts(texts: DataFrame, normalize: bool = True) -> DataFrame:
    """(term, n): how many of the rows (id, text) have each term, and the totals under TEXTS and TOKENS.

    Counted by batches of rows in Python, so that no postings are written.  A term is
    never null and totals are rows like others: where terms are joined no filter goes
    below the count, and Spark reuses its exchange for the totals.
    """
    schema = T.StructType([T.StructField("term", T.StringType(), False), T.StructField("n", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter({TEXTS: b.num_rows, TOKENS: 0})
            for text in b.column("text").to_pylist():
                counts = token_counts(text, normalize)
                found.update(counts.keys())
                found[TOKENS] += counts.total()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    return texts.mapInArrow(run, schema).groupBy("term").agg(F.sum("n").alias("n"))


def bm25_scores(documents: DataFrame, id_col: str, text: Column, queries: DataFrame, query_id: str, query: str, normalize: bool = True, k1: float = K1, b: float = B, expected: int | None = None) -> DataFrame:
    """(query_id, id, score, terms): all pairs that share a term, and how many they share; a null id pairs with nothing, but its text counts in the frequencies.

    Blocks of texts meet blocks of queries and are tokenised there: postings are many
    times the text, and neither they nor what each term adds is ever shuffled,
    broadcast or written.  Rows of one query are one query, rows of one id add up.
    Scores are rounded to twelve places, so that the order of terms does not show.
    ``expected``: about how many documents there are, where counting them costs much; it only
    sets the size of the blocks.
    """
    texts = documents.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = queries.select(query_id, query).where(F.col(query_id).isNotNull()).distinct()
    asked = cut(tokenized(rows, query_id, F.col(query), normalize))
    counts = term_counts(texts, normalize)
    total = lambda key: F.max(F.when(F.col("term") == key, F.col("n")))
    totals = counts.agg(total(TEXTS).alias("n_docs"), (total(TOKENS) / total(TEXTS)).alias("avg_length"))
    # Sizes are guessed far too small here: without the hint all terms may be sent to the driver and broadcast.
    terms = postings(asked).groupBy(F.col("id").alias("query_id"), "term").agg(F.sum("tf").alias("tf")).join(counts.withColumnRenamed("n", "df").hint("merge"), "term").crossJoin(F.broadcast(totals))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.withColumn("weight", idf * F.col("tf")).groupBy(F.col("query_id").alias("id")).agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"), F.max("avg_length").alias("avg_length"))  # as long as a query
    schema = T.StructType([T.StructField("query_id", asked.schema["id"].dataType), T.StructField("id", texts.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("terms", T.LongType())])

    def score(docs: pa.Table, block: pa.Table) -> pa.Table:
        names, ids = block["id"].to_pylist(), pc.unique(docs["id"].drop_null()).to_pylist()
        wanted: dict[str, list[tuple[int, float]]] = {}
        for i, (own, weights) in enumerate(zip(block["terms"].to_pylist(), block["weights"].to_pylist())):
            for t, w in zip(own, weights):
                wanted.setdefault(t, []).append((i, w))
        mean = next(iter(block["avg_length"].to_pylist()), None) or 1.0
        places: dict[str, tuple[list, list]] = {t: ([], []) for t in wanted}
        place = {v: j for j, v in enumerate(ids)}
        for v, words in zip(docs["id"].to_pylist(), docs["text"].to_pylist()) if wanted else ():
            if v is None:
                continue
            tokens, j = token_counts(words, normalize), place[v]
            norm = k1 * (1 - b + b * tokens.total() / mean)
            for t in tokens.keys() & places.keys():
                places[t][0].append(j)
                places[t][1].append(tokens[t] * (k1 + 1) / (tokens[t] + norm))
        scores, shared = np.zeros((len(names), len(ids))), np.zeros((len(names), len(ids)), dtype=np.int64)
        for t in sorted(wanted):
            if places[t][0]:
                adds, n = np.bincount(places[t][0], places[t][1], len(ids)), np.bincount(places[t][0], minlength=len(ids))
                for i, w in wanted[t]:
                    scores[i] += w * adds
                    shared[i] += n
        who, what = np.nonzero(shared)
        out = pa.table({"query_id": pa.array(names, block.schema.field("id").type).take(pa.array(who)), "id": pa.array(ids, docs.schema.field("id").type).take(pa.array(what)), "score": np.round(scores[who, what], 12), "terms": shared[who, what]})
        return pa.Table.from_batches(out.to_batches(ROWS_PER_BATCH), out.schema)

    sizes = expected if expected is not None else texts.count(), asked.select("id").distinct().count()
    return in_blocks(texts, weighted, score, schema, sizes)


def in_blocks(rows: DataFrame, queries: DataFrame, score, schema: T.StructType, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Every block of ``queries`` against every block of ``rows``: ``score`` maps two Arrow tables to one.

    Both sides have an ``id``.  A block of rows is repeated for every block of queries and the other way round; nothing is
    collected or broadcast, and a task holds one block of each whatever their numbers.
    ``sizes``: about how many rows either has, if that is known; else they are counted.
    """
    n, m = (max(1, -(-rows_in // size)) for rows_in, size in zip(sizes or (rows.count(), queries.count()), (DOCUMENTS_PER_BLOCK, QUERIES_PER_BLOCK)))
    part = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = rows.withColumn("_a", part(n)).withColumn("_b", every(m))
    b = queries.withColumn("_b", part(m)).withColumn("_a", every(n))
    return a.groupBy("_a", "_b").cogroup(b.groupBy("_a", "_b")).applyInArrow(score, schema)


def _best(scores: np.ndarray, ids: list, asked: list, k: int, skip_self: bool, types: tuple) -> pa.Table:
    """The k best columns of each row, equal scores by id; ``ids`` are in order."""
    if skip_self:
        place = {v: i for i, v in enumerate(ids)}
        for i, v in enumerate(asked):
            if v in place:
                scores[i, place[v]] = -np.inf
    top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    found = np.take_along_axis(scores, top, 1).ravel()
    keep = np.isfinite(found)
    who = np.repeat(np.arange(len(asked)), top.shape[1])[keep]
    return pa.table({"query_id": pa.array(asked, types[0]).take(pa.array(who)), "id": pa.array(ids, types[1]).take(pa.array(top.ravel()[keep])), "score": pa.array(found[keep])})


def ranked(scores: DataFrame, k: int, *order: Column, query_id: str = "query_id") -> DataFrame:
    """The first k rows of each query by ``order``, with rank from 1; WindowGroupLimit prunes before the shuffle."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*order))).where(F.col("rank") <= k)


def bm25_topk(documents: DataFrame, id_col: str, text: Column, queries: DataFrame, query_id: str, query: str, k: int = 10, normalize: bool = True) -> DataFrame:
    """(query_id, rank, id, score): the k best documents, equal scores by id.

    Documents are tokenised once and written; blocks of queries meet blocks of
    documents, in which only terms that both have are multiplied, and k documents of
    every block go on.  Scores are compared rounded to twelve places.  Documents
    without a common term have score 0 and fill up by id.
    """
    tokens = cut(tokenized(documents, id_col, text, normalize))
    rows = queries.select(query_id, query).where(F.col(query_id).isNotNull()).distinct()
    asked = cut(tokenized(rows, query_id, F.col(query), normalize))
    weights = query_terms(tokens, asked).groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"), F.max("avg_length").alias("avg_length"))  # as long as a query
    weighted = asked.select(F.col("id").alias("query_id")).join(weights, "query_id", "left").withColumnRenamed("query_id", "id")
    schema = T.StructType([T.StructField("query_id", weighted.schema["id"].dataType), T.StructField("id", tokens.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def score(docs: pa.Table, block: pa.Table) -> pa.Table:
        docs = docs.take(pc.sort_indices(docs, [("id", "ascending")]))
        ids, names = docs["id"].to_pylist(), block["id"].to_pylist()
        out = np.zeros((len(names), len(ids)))
        wanted: dict[str, tuple[list, list]] = {}
        mean = next((x for x in block["avg_length"].to_pylist() if x), 1.0)
        for i, (terms, ws) in enumerate(zip(block["terms"].to_pylist(), block["weights"].to_pylist())):
            for t, w in zip(terms or (), ws or ()):
                own = wanted.setdefault(t, ([], []))
                own[0].append(i)
                own[1].append(w)
        places: dict[str, tuple[list, list]] = {t: ([], []) for t in wanted}
        for j, (terms, tfs) in enumerate(zip(docs["terms"].to_pylist(), docs["tfs"].to_pylist())):
            for t, n in zip(terms, tfs):
                if t in places:
                    places[t][0].append(j)
                    places[t][1].append(n)
        norm = K1 * (1 - B + B * docs["length"].to_numpy() / mean)
        for t in sorted(wanted):
            j, tf = places[t]
            if j:
                i, w = wanted[t]
                tf = np.array(tf, dtype=float)
                out[np.ix_(i, j)] += np.outer(w, tf * (K1 + 1) / (tf + norm[j]))
        return _best(np.round(out, 12) + 0.0, ids, names, k, False, (block.schema.field("id").type, docs.schema.field("id").type))

    return ranked(in_blocks(tokens, weighted, score, schema), k, F.col("score").desc(), F.col("id")).select("query_id", "rank", "id", "score")


def dense_topk(vectors: DataFrame, id_col: str, vector_col: str, queries: DataFrame, query_id: str, query_vector: str, k: int = 10, skip_self: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the k nearest vectors by exact cosine, in double precision, equal scores by id.

    Blocks of queries meet blocks of vectors by one matrix product, and k vectors of
    every block go on.  Scores are compared rounded to nine places.  Null vectors are
    left out, a zero vector has score 0.
    """
    side = lambda d, i, v: d.select(F.col(i).alias("id"), F.col(v).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows, asked = side(vectors, id_col, vector_col), side(queries, query_id, query_vector).distinct()
    schema = T.StructType([T.StructField("query_id", asked.schema["id"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def score(docs: pa.Table, block: pa.Table) -> pa.Table:
        if not docs.num_rows or not block.num_rows:
            return pa.table({"query_id": pa.array([], block.schema.field("id").type), "id": pa.array([], docs.schema.field("id").type), "score": pa.array([], pa.float64())})
        docs = docs.take(pc.sort_indices(docs, [("id", "ascending")]))
        s = np.round(unit(block["v"]) @ unit(docs["v"]).T, 9) + 0.0
        return _best(s, docs["id"].to_pylist(), block["id"].to_pylist(), k, skip_self, (block.schema.field("id").type, docs.schema.field("id").type))

    return ranked(in_blocks(rows, asked, score, schema), k, F.col("score").desc(), F.col("id")).select("query_id", "rank", "id", "score")


def rrf(first: DataFrame, second: DataFrame, constant: int = 60, depth: int = 10, k: int = 10, questions: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, score, first_rank, second_rank): reciprocal-rank fusion of two rankings.

    Of each ranking the first ``depth`` count; equal sums go by the better single rank, then by id.
    Both must answer the same questions, and those of ``questions`` if given; otherwise it is an error.
    """
    require_same_queries(first, second, *([questions] if questions is not None else []))
    a = first.where(F.col("rank") <= depth).select("query_id", "id", F.col("rank").alias("first_rank"))
    b = second.where(F.col("rank") <= depth).select("query_id", "id", F.col("rank").alias("second_rank"))
    x = a.join(b, ["query_id", "id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    x = x.withColumn("score", F.round(part("first_rank") + part("second_rank"), 15))
    out = ranked(x, k, F.col("score").desc(), F.least("first_rank", "second_rank"), F.col("id"))
    return out.select("query_id", "rank", "id", F.round("score", 9).alias("score"), "first_rank", "second_rank")


def require_same_queries(*runs: DataFrame) -> None:
    """All runs must answer the same questions."""
    sides = [d.select("query_id", F.lit(i).alias("i")) for i, d in enumerate(runs)]
    both = sides[0]
    for d in sides[1:]:
        both = both.unionByName(d)
    odd = both.groupBy("query_id").agg(F.countDistinct("i").alias("n")).where(F.col("n") < len(runs)).limit(3).collect()
    if odd:
        raise ValueError(f"the runs answer different questions: {[r.query_id for r in odd]}")


def require_frozen(benchmark: DataFrame, sha256: str) -> DataFrame:
    """The benchmark as it is, if its content has the hash it was frozen with; an error otherwise."""
    found = frozen_hash(benchmark)
    if found != sha256:
        raise ValueError(f"the benchmark is not the frozen one: {found}")
    return benchmark


def frozen_hash(benchmark: DataFrame) -> str:
    """Hash of a table's distinct rows whatever their order: the digits of the sum of the rows' hashes, hashed again."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in sorted(benchmark.columns)]), 256)
    digest = lambda a: F.sum(F.conv(F.substring(row, a, 12), 16, 10).cast("decimal(38,0)"))
    r = benchmark.distinct().agg(F.count("*"), *[digest(a) for a in (1, 13, 25, 37)]).first()
    return hashlib.sha256("|".join(map(str, r)).encode()).hexdigest()


def query_metrics(results: DataFrame, benchmark: DataFrame, cutoff: int = 10) -> DataFrame:
    """Per question: ranks of the first gold and first relevant chunk, Hit@1/3/5, Recall@5, reciprocal rank, top chunk.

    ``results`` has query_id, rank, id, score; ``benchmark`` one row per query_id with
    answerability, gold_chunk_ids and supporting_chunk_ids (null as empty).  Questions
    without results have misses.  Cells are null for unanswerable questions; recall is
    null where an answerable one has no gold chunk.
    """
    ids = lambda c: F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))
    q = benchmark.select("query_id", "answerability", ids("gold_chunk_ids").alias("gold"), ids("supporting_chunk_ids").alias("support"))
    x = q.join(results.where(F.col("rank") <= cutoff).select("query_id", "rank", "id", "score"), "query_id", "left")
    gold = F.array_contains("gold", F.col("id"))
    relevant = F.array_contains(F.array_union("gold", "support"), F.col("id"))
    answerable = F.col("answerability") == "answerable"
    agg = x.groupBy("query_id", "answerability", "gold", "support").agg(
        F.min(F.when(gold, F.col("rank"))).alias("first_gold_rank"), F.min(F.when(relevant, F.col("rank"))).alias("first_relevant_rank"),
        F.count_if(gold & (F.col("rank") <= 5)).alias("gold_at_5"), F.min_by("id", "rank").alias("top1_chunk_id"), F.min_by("score", "rank").alias("top1_score"),
    )
    hit = lambda c, k: F.when(answerable, F.coalesce((F.col(c) <= k).cast("int"), F.lit(0)))
    return agg.select(
        "query_id", "answerability", F.size("gold").alias("gold_count"), F.size("support").alias("support_count"),
        F.when(answerable, F.col("first_gold_rank")).alias("first_gold_rank"), F.when(answerable, F.col("first_relevant_rank")).alias("first_relevant_rank"),
        *[hit("first_gold_rank", k).alias(f"hit_at_{k}") for k in (1, 3, 5)], *[hit("first_relevant_rank", k).alias(f"relevant_hit_at_{k}") for k in (1, 3, 5)],
        F.when(answerable & (F.size("gold") > 0), F.col("gold_at_5") / F.size("gold")).alias("recall_at_5"),
        F.when(answerable, F.coalesce(1.0 / F.col("first_gold_rank"), F.lit(0.0))).alias("reciprocal_rank"), "top1_chunk_id", "top1_score",
    )


def run_metrics(per_query: DataFrame) -> DataFrame:
    """One row: macro averages over the answerable questions, six places."""
    a = F.col("answerability") == "answerable"
    mean = lambda c, name: F.round(F.avg(F.when(a, F.col(c))), 6).alias(name)
    return per_query.agg(
        F.count("*").alias("queries"), F.count_if(a).alias("answerable"), *[mean(f"hit_at_{k}", f"hit_at_{k}") for k in (1, 3, 5)], *[mean(f"relevant_hit_at_{k}", f"relevant_hit_at_{k}") for k in (1, 3, 5)],
        mean("recall_at_5", "recall_at_5"), mean("reciprocal_rank", "mrr"),
    )


def compare_two(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("bm25", "dense")) -> DataFrame:
    """Per question the first gold ranks of two runs, their difference where both found it, and the winner; a miss counts as 999."""
    x, y = (d.select("query_id", F.col("first_gold_rank").alias(n)) for d, n in zip((a, b), names))
    z = x.join(y, "query_id", "full_outer")
    p, q = (F.coalesce(n, F.lit(MISS)) for n in names)
    return z.select("query_id", F.col(names[0]).alias(f"{names[0]}_rank"), F.col(names[1]).alias(f"{names[1]}_rank"), (F.col(names[0]) - F.col(names[1])).alias("rank_delta"), F.when(p < q, names[0]).when(q < p, names[1]).otherwise("tie").alias("winner"))


def compare_three(runs: dict[str, DataFrame]) -> DataFrame:
    """Per question all runs that share the best first gold rank, joined by |; an error unless all runs have the same questions."""
    require_same_queries(*runs.values())
    x = None
    for name, d in runs.items():
        y = d.select("query_id", F.coalesce("first_gold_rank", F.lit(MISS)).alias(name))
        x = y if x is None else x.join(y, "query_id")
    best = F.least(*runs)
    return x.select("query_id", *[F.col(n).alias(f"{n}_rank") for n in runs], F.concat_ws("|", *[F.when(F.col(n) == best, F.lit(n)) for n in runs]).alias("winners"))


def winner_counts(compared: DataFrame, column: str = "winner") -> DataFrame:
    return compared.groupBy(column).agg(F.count("*").alias("queries"))


def embed(texts: DataFrame, id_col: str, text_col: str, encoder, prompt: str = "", out_col: str = "embedding", batch_size: int = 4) -> DataFrame:
    """(id, embedding): unit vectors of texts by an injected encoder, a function from a list of texts to rows of numbers.

    The encoder runs in the workers, ``batch_size`` texts at a time; a prompt is put
    before queries only.  Null texts are embedded as empty ones.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s):
        rows = [prompt + (t or "") for t in s]
        m = np.vstack([np.asarray(encoder(rows[i : i + batch_size]), dtype=np.float32) for i in range(0, len(rows), batch_size)]) if rows else np.zeros((0, 1), np.float32)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return type(s)(list(np.divide(m, n, out=np.zeros_like(m), where=n > 0)))

    return texts.select(F.col(id_col), run(text_col).alias(out_col))
