"""Lexico-grammatical patterns with synonym folding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusflow.operators.morphology import Dictionary, annotate, resolve_entries, resolve_words
from korpusflow.sources.corpus import rows_of, token_rows, totals
from korpusflow.sources.scratch import stored

Model = tuple[str, list[dict]]
#: Bytes of the table of places that every worker may hold.
TABLE = 64 << 20
#: Tokens that a worker handles at once, but for longer texts.
STEP = 1 << 20


def synonym_heads(thesaurus: DataFrame, dictionary: Dictionary | None) -> DataFrame:
    """lexeme_id, lemma -> folded_id, folded: the head of the last synset that has the lexeme as a synonym."""
    entries = thesaurus.select(F.col("head").alias("entry")).unionByName(thesaurus.select(F.col("synonym").alias("entry")))
    found = resolve_entries(entries, dictionary)
    head = found.select(F.col("entry").alias("head"), F.struct(F.col("lexeme_id").alias("id"), F.col("lemma").alias("lemma")).alias("to"))
    rows = thesaurus.join(found.select(F.col("entry").alias("synonym"), "lexeme_id", "lemma"), "synonym").join(head, "head")
    return rows.groupBy("lexeme_id", "lemma").agg(F.max_by("to", "ord").alias("to")).select("lexeme_id", "lemma", F.col("to.id").alias("folded_id"), F.col("to.lemma").alias("folded"))


def fitting_surfaces(spark, models: list[Model], dictionary: Dictionary | None, thesaurus: DataFrame | None) -> DataFrame:
    """surface, model (number), k: which surfaces fit which places.

    All that a place asks of a token follows from its surface, so places are
    tested once for each surface of the dictionary, not for each token.  Of
    unknown surfaces only those that patterns or the thesaurus name can fit.
    """
    named = sorted({t[x] for _, ts in models for t in ts for x in ("lemma", "wordform") if t.get(x)})
    lemmas = {r.entry: (r.lexeme_id, r.lemma) for r in resolve_entries(spark.createDataFrame([(x,) for x in named], "entry string"), dictionary).collect()} if named else {}
    forms = {x: r for x, r in zip(named, resolve_words(spark, named, dictionary), strict=True)} if named else {}
    words = spark.createDataFrame([(x,) for x in named], "surface string")
    if thesaurus is not None:
        words = words.unionByName(thesaurus.select(F.col("synonym").alias("surface"))).distinct()
    if dictionary is not None:
        words = words.unionByName(dictionary.resolution().select("surface")).distinct()
    rows = annotate(words, dictionary)
    if thesaurus is None:
        rows = rows.withColumn("folded_id", F.col("lexeme_id")).withColumn("folded", F.col("lemma"))
    else:
        rows = rows.join(synonym_heads(thesaurus, dictionary), ["lexeme_id", "lemma"], "left").withColumn("folded_id", F.coalesce("folded_id", "lexeme_id")).withColumn("folded", F.coalesce("folded", "lemma"))

    def fits(token: dict) -> Column:
        tests = [F.array_contains("grammemes", g) for g in token.get("grammemes") or []]
        if token.get("lemma"):
            i, lemma = lemmas[token["lemma"]]
            tests.append((F.col("folded_id") == i) & (F.col("folded") == lemma) | (F.col("form_lexeme_id") == i) & (F.col("form_lemma") == lemma))
        if token.get("wordform"):
            r = forms[token["wordform"]]
            tests.append((F.col("form_lexeme_id") == r["form_lexeme_id"]) & (F.col("f_idx") == r["f_idx"]) & (F.col("form") == r["form"]))
        return reduce(lambda a, b: a & b, tests)

    places = [F.when(fits(t), F.struct(F.lit(n).alias("model"), F.lit(k).alias("k"))) for n, (_, ts) in enumerate(models) for k, t in enumerate(ts) if asks(t)]
    empty = F.array().cast("array<struct<model: int, k: int>>")
    return rows.select("surface", F.explode(F.array_compact(F.array(*places)) if places else empty).alias("p")).select("surface", "p.model", "p.k")


def asks(token: dict) -> bool:
    return bool(token.get("lemma") or token.get("wordform") or token.get("grammemes"))


def place_table(fitting: DataFrame, models: list[Model], table_bytes: int) -> tuple[pa.Array, np.ndarray] | None:
    """Surfaces, and for each of them, each place and every 64 patterns a word with a bit for each pattern that it fits there.

    One row more stands for all other surfaces.  A pattern that ends before a
    place, or asks for nothing there, fits with any.  None if the table would
    be larger than table_bytes.
    """
    most, words = max(1, *(len(ts) for _, ts in models)), (len(models) + 63) // 64
    # the fitting rows themselves come to the driver first, so they are weighed too
    n, rows, size = fitting.agg(F.count_distinct("surface"), F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("surface")), F.lit(0))).first()
    if (n + 1) * most * words * 8 + rows * 8 + size > table_bytes:
        return None
    table = fitting.toArrow()
    coded = table.column("surface").combine_chunks().cast(pa.string()).dictionary_encode() if rows else pa.array([], pa.string()).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    masks = np.zeros((len(coded.dictionary) + 1, most, words), dtype=np.uint64)
    for model, (_, ts) in enumerate(models):
        for k in range(most):
            if ts and (k >= len(ts) or not asks(ts[k])):
                masks[:, k, model // 64] |= np.uint64(1 << model % 64)
    model = table.column("model").to_numpy().astype(np.int64)
    np.bitwise_or.at(masks, (coded.indices.to_numpy(), table.column("k").to_numpy().astype(np.int64), model // 64), np.left_shift(np.uint64(1), (model % 64).astype(np.uint64)))
    return coded.dictionary, masks


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about STEP tokens at a time."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("w")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
        yield batch.slice(at, to - at)
        at = to


def _matches(table, sizes: list[int], include_last: bool, batch: pa.RecordBatch) -> tuple[pa.Array, Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The rows' tokens in a row, and for each pattern: rows, places in them and among all tokens where it matches.

    All patterns at once: the word of a place is the AND of what the token there
    fits as first, the next one as second and so on.
    """
    surfaces, masks = table.value
    lengths = pc.fill_null(pc.list_value_length(batch.column("w")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = batch.column("w").flatten()
    coded = flat.dictionary_encode()
    code = pc.fill_null(pc.index_in(coded.dictionary.cast(pa.string()), value_set=surfaces), len(surfaces)).to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
    ends = np.cumsum(lengths)

    def found() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for word in range(masks.shape[2]):
            fits = masks[code, 0, word]
            for k in range(1, masks.shape[1]):
                fits[:-k] &= masks[code[k:], k, word]
            at = np.flatnonzero(fits)
            bits, row = fits[at], np.searchsorted(ends, at, "right")
            room = ends[row] - at - (0 if include_last else 1)
            for n, size in enumerate(sizes[64 * word : 64 * word + 64]):
                hit = (bits >> np.uint64(n) & np.uint64(1)).astype(bool) & (room >= size)
                yield 64 * word + n, row[hit], at[hit] - (ends - lengths)[row[hit]], at[hit]

    return flat, found()


def _hits(table, models: list[Model], include_last: bool):
    sizes = [len(ts) for _, ts in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _steps(whole):
                flat, found = _matches(table, sizes, include_last, batch)
                for model, row, pos, at in found:
                    if not len(at):
                        continue
                    offsets = pa.array(np.arange(len(at) + 1, dtype=np.int64) * sizes[model])
                    words = pa.LargeListArray.from_arrays(offsets, flat.take(pa.array((at[:, None] + np.arange(sizes[model])).ravel())))
                    forms = pc.binary_join(words, " ").cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([models[model][0]] * len(at), pa.string()), batch.column("doc_id").take(pa.array(row)), pa.array(pos, pa.int64()), forms], ["model", "doc_id", "pos", "forms"])

    return run


def _sums(table, models: list[Model], include_last: bool):
    """For each step a row for each pattern with its matches and rows, and one of number -1 with all tokens and rows."""
    sizes = [len(ts) for _, ts in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _steps(whole):
                flat, found = _matches(table, sizes, include_last, batch)
                out = [(-1, len(flat), batch.num_rows), *((model, len(at), len(np.unique(row))) for model, row, _, at in found if len(at))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), pa.int64()], strict=True)], ["number", "freq", "texts"])

    return run


def pattern_hits(corpus: DataFrame, models: list[Model], dictionary: Dictionary | None = None, thesaurus: DataFrame | None = None, include_last: bool = False, table_bytes: int = TABLE) -> DataFrame:
    """model, doc_id, pos, forms (surfaces, space-joined): every match, overlapping ones too.

    The last possible start of a document isn't tried unless include_last.  A
    row is a document, whatever its id.  A pattern without tokens never matches.

    Which surfaces fit which places is a table of bits; while that is smaller
    than table_bytes, workers hold it and find a row's matches among its own
    tokens: nothing is shuffled.  Larger ones are joined (_by_votes).
    """
    if not models:
        return corpus.select(F.lit("").alias("model"), "doc_id", F.lit(0).cast("long").alias("pos"), F.lit("").alias("forms")).where(F.lit(False))
    fitting = stored(fitting_surfaces(corpus.sparkSession, models, dictionary, thesaurus), "fitting")
    table = place_table(fitting, models, table_bytes)
    if table is None:
        return _by_votes(rows_of(corpus), fitting, models, include_last).select("model", "doc_id", "pos", "forms")
    held = corpus.sparkSession.sparkContext.broadcast(table)
    return token_rows(corpus).mapInArrow(_hits(held, models, include_last), f"model string, doc_id {corpus.schema['doc_id'].dataType.simpleString()}, pos long, forms string")


def _by_votes(docs: DataFrame, fitting: DataFrame, models: list[Model], include_last: bool) -> DataFrame:
    """The same with row: each place of each pattern votes for the starts at which it would fit; a start with the votes of all places that ask for something is a match.

    Only tokens that fit a place are shuffled, after the join on the surface.
    """
    m = F.element_at(F.array(*(F.lit(len(ts)) for _, ts in models)), F.col("model") + 1)
    need = F.element_at(F.array(*(F.lit(sum(map(asks, ts))) for _, ts in models)), F.col("model") + 1)
    most = max(1, *(len(ts) for _, ts in models))
    # each token with those before and behind it that a pattern could reach
    around = F.slice("w", F.greatest(F.lit(1), F.col("at") + 2 - most), F.least(F.col("at"), F.lit(most - 1)) + most).alias("around")
    rows = docs.select("row", "doc_id", "w", F.posexplode("w").alias("at", "surface")).select("row", "doc_id", F.size("w").alias("n"), "at", "surface", around)
    free = [n for n, (_, ts) in enumerate(models) if ts and not any(map(asks, ts))]
    votes = rows.join(fitting, "surface").withColumn("start", F.col("at") - F.col("k"))
    inside = (F.col("start") >= 0) & ((F.col("start") + m <= F.col("n")) if include_last else (F.col("start") + m < F.col("n")))
    words = F.slice("around", F.col("start") - F.greatest(F.lit(0), F.col("at") - most + 1) + 1, m)
    votes = votes.where(inside).select("row", "doc_id", "model", "start", F.array_join(words, " ").alias("forms"))
    found = votes.groupBy("row", "model", "start").agg(F.count(F.lit(1)).alias("c"), F.first("doc_id").alias("doc_id"), F.first("forms").alias("forms")).where(F.col("c") == need)
    if free:  # patterns that ask for nothing fit wherever there is room
        every = rows.withColumn("k", F.lit(0)).select("*", F.explode(F.array(*map(F.lit, free))).alias("model")).withColumn("start", F.col("at")).where(inside)
        found = found.select("row", "model", "doc_id", "start", "forms").unionByName(every.select("row", "model", "doc_id", "start", F.array_join(words, " ").alias("forms")))
    name = F.element_at(F.array(*(F.lit(x) for x, _ in models)), F.col("model") + 1)
    return found.select("row", F.col("model").alias("number"), name.alias("model"), "doc_id", F.col("start").cast("long").alias("pos"), "forms")


def pattern_stats(corpus: DataFrame, models: list[Model], dictionary: Dictionary | None = None, thesaurus: DataFrame | None = None, include_last: bool = False, table_bytes: int = TABLE) -> DataFrame:
    """model, freq, texts, tfidf: every model, also of one name; one without hits has freq 0 and no tfidf.

    One pass over the texts counts matches, tokens and rows; at most a row for each model reaches the driver.
    """
    spark = corpus.sparkSession
    names = spark.createDataFrame([(n, name) for n, (name, _) in enumerate(models)], "number int, model string")
    fitting = stored(fitting_surfaces(spark, models, dictionary, thesaurus), "fitting") if models else None
    table = place_table(fitting, models, table_bytes) if models else None
    if table is not None:
        sums = token_rows(corpus).mapInArrow(_sums(spark.sparkContext.broadcast(table), models, include_last), "number int, freq long, texts long")
        sums = {r.number: (r.freq, r.texts) for r in sums.groupBy("number").agg(F.sum("freq").alias("freq"), F.sum("texts").alias("texts")).collect()}
        words, files = sums.pop(-1, (0, 0))
        each = spark.createDataFrame([(n, *k) for n, k in sums.items()], "number int, freq long, texts long")
    else:
        words, files = totals(corpus).first()
        hits = _by_votes(rows_of(corpus), fitting, models, include_last) if models else spark.createDataFrame([], "row long, number int")
        each = hits.groupBy("number", "row").agg(F.count(F.lit(1)).alias("k")).groupBy("number").agg(F.sum("k").alias("freq"), F.count(F.lit(1)).alias("texts"))
    out = names.join(each, "number", "left").select("model", F.coalesce("freq", F.lit(0)).cast("long").alias("freq"), F.coalesce("texts", F.lit(0)).cast("long").alias("texts"))
    tfidf = F.col("freq") / F.lit(float(max(words, 1))) * F.ln(F.lit(float(files)) / F.col("texts"))
    return out.withColumn("tfidf", F.when(F.col("texts") > 0, F.round(tfidf, 6)))
