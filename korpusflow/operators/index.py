"""A stored positional index: BM25, its best k by block maxima, and phrases, without the corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusflow.functions.arrow import pieces, token_array
from korpusflow.operators.concordance import phrase_lexemes
from korpusflow.operators.morphology import Dictionary, unknown_columns
from korpusflow.operators.search import K1, B, query_lexemes
from korpusflow.sources import snapshots
from korpusflow.sources.scratch import discard, stored

#: Folders that lexemes are dealt to.
BUCKETS = 64
#: A block holds one lexeme's postings of at most 2^CHUNK rows that follow each other.
CHUNK = 7
#: Slices of the buckets that are shuffled one after the other, at most, and one for each 2^WORDS words.
SLICES, WORDS = 8, 20

Lexeme = tuple[int, str]


def _bucket(lexeme_id: Column, lemma: Column) -> Column:
    return F.pmod(F.xxhash64(lexeme_id, lemma), F.lit(BUCKETS)).cast("int")


def _weight(tf: Column, n: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / F.lit(average)))


@dataclass
class Index:
    """docs(row, doc_id, n), terms(bucket, lexeme_id, lemma, df, occ), postings(bucket, lexeme_id, lemma, chunk, best, rows, lengths, tfs, places) and totals."""

    spark: SparkSession
    path: str
    files: int
    words: int
    dictionary: Dictionary | None = None

    @property
    def average(self) -> float:
        return self.words / self.files if self.files and self.words else 1.0

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _of(self, name: str, lexemes: list[Lexeme]) -> DataFrame:
        """A table's rows of these lexemes: only their buckets are read."""
        buckets = self.spark.createDataFrame(lexemes, "lexeme_id long, lemma string").select(_bucket(F.col("lexeme_id"), F.col("lemma")).alias("b")).distinct().collect()
        own = F.lit(False)
        for i, lemma in lexemes:
            own = own | ((F.col("lexeme_id") == i) & (F.col("lemma") == lemma))
        return self.table(name).where(F.col("bucket").isin(*(r.b for r in buckets)) & own)

    def postings(self, lexemes: list[Lexeme], positions: bool = False) -> DataFrame:
        """lexeme_id, lemma, chunk, row, n, tf (and places) of these lexemes."""
        blocks = self._of("postings", lexemes)
        rows = blocks.select("lexeme_id", "lemma", "chunk", "lengths", "tfs", *(["places"] if positions else []), F.posexplode("rows").alias("k", "off"))
        row = (F.shiftleft("chunk", CHUNK) + F.col("off")).alias("row")
        return rows.select("lexeme_id", "lemma", "chunk", row, F.get("lengths", F.col("k")).alias("n"), F.get("tfs", F.col("k")).alias("tf"), *([F.get("places", F.col("k")).alias("places")] if positions else []))


def _lengths(texts: DataFrame) -> DataFrame:
    """row, doc_id, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(token_array(b.column(2))[1])], ["row", "doc_id", "n"])

    return texts.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {texts.schema['doc_id'].dataType.simpleString()}, n long")


def _blocks(texts: DataFrame) -> DataFrame:
    """surface, chunk, m (row, n, places): postings of each surface in a range of rows, grouped where the texts are read; a range that is read in parts gives some for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            flat, sizes = token_array(b.column(1))
            if not len(flat):
                continue
            words, rows = flat.dictionary_encode(), b.column(0).to_numpy()
            text = np.repeat(np.arange(len(sizes)), sizes)
            code, chunk = words.indices.to_numpy(), rows[text] >> CHUNK
            order = np.lexsort((rows[text], code, chunk))  # stable: places stay in order
            code, chunk, text, place = code[order], chunk[order], text[order], (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
            block = np.r_[True, (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])]
            posting = np.flatnonzero(block | np.r_[True, text[1:] != text[:-1]])
            first = np.flatnonzero(block)
            own = text[posting]
            places = pa.ListArray.from_arrays(pa.array(np.r_[posting, len(flat)], pa.int32()), pa.array(place.astype(np.int32)))
            members = pa.StructArray.from_arrays([pa.array(rows[own]), pa.array(sizes[own].astype(np.int64)), places], ["row", "n", "places"])
            m = pa.ListArray.from_arrays(pa.array(np.r_[np.searchsorted(posting, first), len(posting)], pa.int32()), members)
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[first])), pa.array(chunk[first]), m], ["surface", "chunk", "m"])

    return texts.select("row", "text").mapInArrow(run, "surface string, chunk long, m array<struct<row: long, n: long, places: array<int>>>")


def _one_each(m: Column) -> Column:
    """The postings of a block with one for each row: a known lexeme may have several surfaces in a row."""
    rows = F.transform(m, lambda x: x["row"])
    own = lambda row: F.filter(m, lambda x: x["row"] == row)
    merged = F.transform(F.array_distinct(rows), lambda row: F.struct(row.alias("row"), F.get(own(row), F.lit(0))["n"].alias("n"), F.array_sort(F.flatten(F.transform(own(row), lambda x: x["places"]))).alias("places")))
    return F.when(F.size(F.array_distinct(rows)) == F.size(rows), m).otherwise(merged)


def _grouped(dealt: DataFrame, several: bool, average: float) -> DataFrame:
    """The blocks of postings from their parts; several: a lexeme may have some surfaces."""
    keys = ["lexeme_id", "lemma", "chunk"]
    blocks = dealt.repartition("bucket", "part").groupBy("bucket", "part", *keys).agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("m"))
    if several:
        blocks = blocks.withColumn("m", _one_each(F.col("m")))
    blocks = blocks.withColumns({"rows": F.transform("m", lambda x: (x["row"] - F.shiftleft("chunk", CHUNK)).cast("int")), "lengths": F.transform("m", lambda x: x["n"]), "tfs": F.transform("m", lambda x: F.size(x["places"]).cast("long")), "places": F.transform("m", lambda x: x["places"])})
    best = F.array_max(F.zip_with("tfs", "lengths", lambda tf, n: _weight(tf, n, average)))
    return blocks.select("bucket", *keys, best.alias("best"), "rows", "lengths", "tfs", "places").sortWithinPartitions("bucket", "lexeme_id", "chunk")


def build_index(corpus: DataFrame, path: str, dictionary: Dictionary | None = None) -> Index:
    """Writes the index of a corpus as a new version of the snapshot at `path`.

    A row is a document, whatever its id.  Postings are grouped by lexeme and
    by ranges of 128 rows, so a block is small however common the lexeme; rows
    are kept as their distance from the range's first, beside each block's highest weight in BM25.
    """
    spark = corpus.sparkSession
    texts = stored(corpus.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "index-rows")
    docs = stored(_lengths(texts), "index-docs")
    files, words = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    average = words / files if files and words else 1.0
    keys = ["lexeme_id", "lemma", "chunk"]
    found, kept = _blocks(texts), []
    if dictionary is not None:  # stored, so that its size is known and a small one is broadcast
        kept.append(stored(dictionary.resolution().select("surface", "lexeme_id", "lemma"), "index-words"))
        found = found.join(kept[0], "surface", "left")
    unknown = unknown_columns()
    parts = found.select(*((F.coalesce(k, unknown[k]) if dictionary is not None else unknown[k]).alias(k) for k in keys[:2]), "chunk", "m")
    # common lexemes have many blocks: their chunks deal them to more tasks than one for each bucket; one shuffle groups and deals
    dealt = parts.withColumn("bucket", _bucket(F.col("lexeme_id"), F.col("lemma"))).withColumn("part", F.pmod(F.xxhash64("lexeme_id", "chunk"), F.lit(4)))
    # the texts are read once for each slice of the buckets, so only a slice's shuffle is on disk at once
    slices = max(1, min(SLICES, words >> WORDS))
    postings = [_grouped(dealt.where(F.col("bucket") % slices == k), dictionary is not None, average) for k in range(slices)]
    count = lambda at: spark.read.parquet(f"{at}/postings").groupBy("bucket", "lexeme_id", "lemma").agg(F.sum(F.size("rows")).alias("df"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("occ"))
    total = spark.createDataFrame([(files, words)], "files long, words long")
    tables = {"docs": docs, "postings": postings, "terms": lambda at: count(at).repartition("bucket"), "totals": total}
    at = snapshots.publish(spark, path, tables, {"postings": ("bucket",), "terms": ("bucket",)})
    discard(texts, docs, *kept)
    return Index(spark, at, files, words, dictionary)


def open_index(spark: SparkSession, path: str, dictionary: Dictionary | None = None) -> Index:
    at = snapshots.version_at(spark, path)
    if at is None:
        raise FileNotFoundError(f"no index at {path}; build it first")
    total = spark.read.parquet(f"{at}/totals").first()
    return Index(spark, at, total.files, total.words, dictionary)


def _idf(index: Index, lexemes: list[Lexeme]) -> list[tuple[int, str, float]]:
    df = {(r.lexeme_id, r.lemma): r.df for r in index._of("terms", lexemes).collect()}
    return [(*x, math.log((index.files - df[x] + 0.5) / (df[x] + 0.5))) for x in lexemes if x in df]


def _scores(index: Index, postings: DataFrame, idf: DataFrame) -> DataFrame:
    rows = postings.join(F.broadcast(idf), ["lexeme_id", "lemma"])
    return rows.groupBy("row").agg(F.round(F.sum(F.col("idf") * _weight(F.col("tf"), F.col("n"), index.average)), 6).alias("score")).where("score > 0")


def _named(index: Index, scores: DataFrame) -> DataFrame:
    return scores.join(index.table("docs").select("row", "doc_id"), "row").select("doc_id", "score")


def bm25(index: Index, query: str, thesaurus: DataFrame | None = None) -> DataFrame:
    """doc_id, score > 0, as search.bm25 gives them, from the query's postings alone."""
    lexemes = query_lexemes(index.table("docs"), query, index.dictionary, thesaurus)
    found = _idf(index, lexemes) if lexemes else []
    idf = index.spark.createDataFrame(found, "lexeme_id long, lemma string, idf double")
    if not found:
        return _named(index, index.spark.createDataFrame([], "row long, score double"))
    return _named(index, _scores(index, index.postings([x[:2] for x in found]), idf))


def best(index: Index, query: str, k: int, thesaurus: DataFrame | None = None) -> tuple[DataFrame, int, int]:
    """The k best of bm25 (ties: smaller ids first), the chunks of rows read for them and all that hold a query's lexeme.

    A chunk scores at most the sum of its blocks' highest weights.  The k chunks
    that promise most are scored first; only chunks that promise no less than the
    k-th score found there are read for the result.
    """
    lexemes = query_lexemes(index.table("docs"), query, index.dictionary, thesaurus)
    found = _idf(index, lexemes) if lexemes else []
    if not found or k < 1:
        return bm25(index, "", None).limit(0), 0, 0
    idf = index.spark.createDataFrame(found, "lexeme_id long, lemma string, idf double")
    own = [x[:2] for x in found]
    promise = index._of("postings", own).select("lexeme_id", "lemma", "chunk", "best").join(F.broadcast(idf), ["lexeme_id", "lemma"])
    promise = stored(promise.groupBy("chunk").agg(F.sum(F.greatest(F.lit(0.0), F.col("idf") * F.col("best"))).alias("most")), "promises")
    postings = index.postings(own)
    first = _scores(index, postings.join(promise.orderBy(F.desc("most"), "chunk").limit(k).select("chunk"), "chunk", "left_semi"), idf)
    floor = [r.score for r in first.orderBy(F.desc("score")).limit(k).collect()]
    least = floor[-1] if len(floor) == k else 0.0
    chunks = promise.where(F.col("most") >= least - 1e-6).select("chunk")
    read, every = promise.agg(F.count_if(F.col("most") >= least - 1e-6), F.count(F.lit(1))).first()
    out = _named(index, _scores(index, postings.join(chunks, "chunk", "left_semi"), idf)).orderBy(F.desc("score"), "doc_id").limit(k)
    return out, read, every


def phrase_places(index: Index, phrase: str) -> DataFrame:
    """doc_id, pos: where the lexemes of the phrase follow each other: position lists, each shifted by its place in the phrase, are intersected row by row."""
    spark = index.spark
    wanted = phrase_lexemes(index.table("docs"), phrase, index.dictionary)
    at = spark.createDataFrame([(i, lemma, k) for k, (i, lemma) in enumerate(wanted)], "lexeme_id long, lemma string, at long")
    lists = index.postings(sorted(set(wanted)), positions=True).join(F.broadcast(at), ["lexeme_id", "lemma"]).select("row", F.transform("places", lambda p: (p - F.col("at")).cast("long")).alias("starts"))
    met = lists.groupBy("row").agg(F.collect_list("starts").alias("all")).where(F.size("all") == len(wanted))
    starts = met.select("row", F.explode(F.aggregate("all", F.get("all", F.lit(0)), lambda a, x: F.array_intersect(a, x))).alias("pos"))
    return starts.join(index.table("docs").select("row", "doc_id"), "row").select("doc_id", "pos")
