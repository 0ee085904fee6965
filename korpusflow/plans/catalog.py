"""The engine's queries over the driver's tables, with the same in DuckDB SQL."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusflow.functions import text as T
from korpusflow.operators import concordance, frequency, index, morphology, ngrams, patterns, ranks, report, search, unknown
from korpusflow.sources import corpus as C
from korpusflow.sources.scratch import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: A small dictionary over the documents' commonest words.
LEXEMES = [
    (1, "the", "PRCL", ["PRCL"]), (2, "of", "PREP", ["PREP"]), (3, "and", "CONJ", ["CONJ"]), (4, "be", "VERB", ["VERB"]), (5, "la", "NOUN", ["NOUN"]),
    (6, "la", "NPRO", ["NPRO"]), (7, "der", "ADJF", ["ADJF"]), (8, "being", "GRND", ["GRND"]), (9, "to", "PREP", ["PREP"]), (10, "will", "NOUN", ["NOUN"]), (11, "que", "CONJ", ["CONJ"]),
]
FORMS = [
    (1, 0, "the", ["PRCL"]), (2, 0, "of", ["PREP"]), (3, 0, "and", ["CONJ"]), (3, 1, "und", ["CONJ"]), (3, 2, "et", ["CONJ"]), (4, 0, "is", ["VERB", "pres", "sing"]), (4, 1, "are", ["VERB", "pres", "plur"]),
    (4, 2, "was", ["VERB", "past", "sing"]), (5, 0, "la", ["NOUN", "sing"]), (6, 0, "la", ["NPRO", "sing"]), (7, 0, "der", ["ADJF", "masc"]), (7, 1, "die", ["ADJF", "femn"]), (8, 0, "ing", ["GRND", "pres"]),
    (9, 0, "to", ["PREP"]), (10, 0, "on", ["NOUN", "sing"]), (11, 0, "que", ["CONJ"]),
]
LINKS = [(4, 8, 5), (1, 2, 7)]
FREQUENCIES = [("la", "s", 5.0, 0), ("la", "spro", 10.0, 1), ("being", "v", 900.0, 2), ("the", "part", 100.0, 3), ("the", "part", 50.0, 4)]
#: What the dictionary makes of each surface: form's lemma, its part of speech, grammemes, lemma, part of speech.
RESOLUTION = [
    ("the", "the", "PRCL", "PRCL", "the", "PRCL"), ("of", "of", "PREP", "PREP", "of", "PREP"), ("and", "and", "CONJ", "CONJ", "and", "CONJ"), ("und", "and", "CONJ", "CONJ", "and", "CONJ"),
    ("et", "and", "CONJ", "CONJ", "and", "CONJ"), ("is", "be", "VERB", "VERB pres sing", "be", "VERB"), ("are", "be", "VERB", "VERB plur pres", "be", "VERB"), ("was", "be", "VERB", "VERB past sing", "be", "VERB"),
    ("la", "la", "NPRO", "NPRO sing", "la", "NPRO"), ("der", "der", "ADJF", "ADJF masc", "der", "ADJF"), ("die", "der", "ADJF", "ADJF femn", "der", "ADJF"), ("ing", "being", "GRND", "GRND pres", "be", "VERB"),
    ("to", "to", "PREP", "PREP", "to", "PREP"), ("on", "will", "NOUN", "NOUN sing", "will", "NOUN"), ("que", "que", "CONJ", "CONJ", "que", "CONJ"),
]
THESAURUS = [("der", "be", 0), ("der", "will", 1), ("to", "will", 2)]
MODELS = [
    ("be NOUN", [{"lemma": "be"}, {"grammemes": ["NOUN"]}]), ("der any", [{"lemma": "der"}, {}]), ("the was", [{"wordform": "the"}, {"wordform": "was"}]),
    ("past VERB PREP", [{"grammemes": ["VERB", "past"]}, {"grammemes": ["PREP"]}]), ("never", [{"lemma": "no such lemma"}]),
]
FUNCTION = "('NPRO', 'PREP', 'CONJ', 'PRCL', 'INTJ')"


def toy(spark: SparkSession) -> morphology.Dictionary:
    return morphology.Dictionary.of(spark, LEXEMES, FORMS, LINKS, FREQUENCIES)


def toy_thesaurus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(THESAURUS, "head string, synonym string, ord long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table_corpus(C.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "doc_id", "text")


def _tok(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs: docs(doc_id, w), tok(doc_id, surface, i, n)."""
    return f"""docs AS (SELECT {key} AS doc_id, {T.sql_tokens(text)} AS w FROM {table}),
        tok AS (SELECT doc_id, unnest(w) AS surface, unnest(range(len(w))) AS i, len(w) AS n FROM docs),
        total AS (SELECT CAST(sum(len(w)) AS DOUBLE) AS words, CAST(count(*) AS DOUBLE) AS files FROM docs)"""


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


#: key and form_key tell lexemes apart: a word that no form has isn't the lexeme whose lemma is spelt like it.
_ANN = f"""ann AS (SELECT t.*, coalesce(form_lemma, surface) AS form_lemma, coalesce(form_pos, 'UNKN') AS form_pos, coalesce(grammemes, '') AS grammemes,
        coalesce(lemma, surface) AS lemma, coalesce(pos, 'UNKN') AS pos, coalesce(lemma || '/' || pos, '?' || surface) AS key, coalesce(form_lemma || '/' || form_pos, '?' || surface) AS form_key
        FROM tok t LEFT JOIN (SELECT * FROM {_values(RESOLUTION)} r(form, form_lemma, form_pos, grammemes, lemma, pos)) r ON t.surface = r.form)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {_tok()} SELECT doc_id, CAST(i AS INTEGER) AS \"at\", surface FROM tok")
def tokenize(spark, d):
    return C.token_table(documents(spark, d))


@query(f"""WITH {_tok()}, raw AS (SELECT DISTINCT unnest(string_split_regex(text, '{T.SEPARATORS}')) AS x FROM documents)
    SELECT x, translate(x, '{T.UPPER}', '{T.LOWER}') AS low, translate(x, 'ёЁ', 'еЕ') AS plain, replace(x, chr(769), '') AS unaccented, CAST(length(x) AS INTEGER) AS size FROM raw""")
def normalize_variants(spark, d):
    x = F.col("x")
    raw = documents(spark, d).select(F.explode(F.split("text", T.SEPARATORS)).alias("x")).distinct()
    return raw.select("x", T.lowered(x).alias("low"), T.deyotized(x).alias("plain"), T.unaccented(x).alias("unaccented"), F.char_length("x").alias("size"))


@query(f"WITH {_tok()} SELECT CAST(words AS BIGINT) AS total_words, CAST(files AS BIGINT) AS total_files FROM total")
def corpus_stats(spark, d):
    return C.totals(documents(spark, d))


@query(f"WITH {_tok()} SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens FROM docs")
def doc_lengths(spark, d):
    return C.lengths(documents(spark, d))


def _frequency_sql(where: str, ann: bool, tok: str = "") -> str:
    source, extra = ("ann", f", {_ANN}") if ann else ("(SELECT *, surface AS lemma, 'UNKN' AS pos FROM tok)", "")
    return f"""WITH {tok or _tok()}{extra} SELECT lemma, pos, count(*) AS occ, round(count(*) * 1e6 / any_value(words), 6) AS ipm, count(DISTINCT doc_id) AS texts
        FROM {source}, total WHERE {where} GROUP BY lemma, pos"""


@query(_frequency_sql("true", False))
def lemma_frequency(spark, d):
    return frequency.frequency_list(documents(spark, d))


@query(_frequency_sql("pos <> 'UNKN'", True))
def lemma_frequency_known(spark, d):
    return frequency.frequency_list(documents(spark, d), toy(spark), frequency.known)


@query(_frequency_sql(f"pos <> 'UNKN' AND pos NOT IN {FUNCTION}", True))
def lemma_frequency_no_function_words(spark, d):
    return frequency.frequency_list(documents(spark, d), toy(spark), frequency.content)


@query(_frequency_sql("pos = 'UNKN'", True))
def unknown_frequency(spark, d):
    return frequency.frequency_list(documents(spark, d), toy(spark), frequency.unknown)


@query(f"WITH {_tok()} SELECT surface AS lemma, count(DISTINCT doc_id) AS df FROM tok GROUP BY surface")
def document_frequency(spark, d):
    return frequency.postings(documents(spark, d)).groupBy("lemma").agg(F.count(F.lit(1)).alias("df"))


@query(f"WITH {_tok()}, {_ANN} SELECT any_value(lemma) AS lemma, doc_id, count(*) AS tf FROM ann GROUP BY key, doc_id")
def postings(spark, d):
    return frequency.postings(documents(spark, d), toy(spark))


def _concordance_sql(phrase: list[str], context: int, threshold: int, side: str, ann: bool) -> str:
    m = len(phrase)
    source = f", {_ANN}, lem AS (SELECT doc_id, list(lemma ORDER BY i) AS w, list(key ORDER BY i) AS x FROM ann GROUP BY doc_id)" if ann else ", lem AS (SELECT doc_id, w, w AS x FROM docs)"
    return f"""WITH {_tok()}{source}, places AS (SELECT doc_id, w, x, unnest(range(1, len(w) - {m} + 2)) AS p FROM lem WHERE len(w) >= {m}),
        hit AS (SELECT w, x, p FROM places WHERE {' AND '.join(f"x[p + {k}] = '{x}'" for k, x in enumerate(phrase))}),
        cut AS (SELECT w, x, p, a, b FROM hit, range(0, {context + 1}) ra(a), range(0, {context + 1}) rb(b) WHERE a + b BETWEEN 1 AND {context} AND {side} AND a < p AND p + {m} - 1 + b <= len(w))
        SELECT any_value(CASE WHEN a > 0 THEN array_to_string(w[p - a:p - 1], ' ') ELSE '' END) AS "left", any_value(CASE WHEN b > 0 THEN array_to_string(w[p + {m}:p + {m} - 1 + b], ' ') ELSE '' END) AS "right", count(*) AS freq
        FROM cut GROUP BY CASE WHEN a > 0 THEN x[p - a:p - 1] END, CASE WHEN b > 0 THEN x[p + {m}:p + {m} - 1 + b] END HAVING count(*) >= {threshold}"""


@query(_concordance_sql(["the", "the"], 2, 2, "b = 0", False))
def concordance_left(spark, d):
    return concordance.concordance(documents(spark, d), "the the", 2, 2, "left")


@query(_concordance_sql(["the", "the"], 2, 1, "a = 0", False))
def concordance_right(spark, d):
    return concordance.concordance(documents(spark, d), "The the", 2, 1, "right")


@query(_concordance_sql(["be/VERB"], 2, 1, "a > 0 AND b > 0", True))
def concordance_both(spark, d):
    return concordance.concordance(documents(spark, d), "was", 2, 1, "both", toy(spark))


@query(f"WITH {_tok()} SELECT doc_id, CAST(p - 1 AS BIGINT) AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS p FROM docs WHERE len(w) > 1) WHERE w[p] = 'of' AND w[p + 1] = 'the'")
def phrase_match_positions(spark, d):
    return concordance.matches(documents(spark, d), "of the").select("doc_id", "pos")


@query(f"""WITH {_tok()}, g AS (SELECT doc_id, surface || ' ' || lead(surface) OVER (PARTITION BY doc_id ORDER BY i) AS gram, i, n FROM tok)
    SELECT gram, count(*) AS occ, count(DISTINCT doc_id) AS df, round(count(*) / any_value(words) * ln(any_value(files) / count(DISTINCT doc_id)), 6) AS tfidf FROM g, total WHERE i + 1 < n GROUP BY gram""")
def bigrams_tfidf(spark, d):
    docs = documents(spark, d)
    total = C.totals(docs).first()
    tfidf = F.col("occ") / F.lit(float(total["total_words"])) * F.ln(F.lit(float(total["total_files"])) / F.col("df"))
    return ngrams.gram_counts(docs, 2).select("gram", "occ", "df", F.round(tfidf, 6).alias("tfidf"))


def _stable_sql(max_n: int, f: int, s: float, where: str) -> str:
    return f"""WITH {_tok()}, g AS (SELECT doc_id, array_to_string(w[p:p + k - 1], ' ') AS gram, k AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM docs), range(2, {max_n + 2}) r(k) WHERE p + k - 1 <= len(w)),
        c AS (SELECT gram, n, count(*) AS occ, count(DISTINCT doc_id) AS df FROM g GROUP BY gram, n),
        e AS (SELECT gram, max(occ) AS ext FROM (SELECT array_to_string(list_slice(string_split(gram, ' '), 1, n - 1), ' ') AS gram, occ FROM c WHERE n > 2
              UNION ALL SELECT array_to_string(list_slice(string_split(gram, ' '), 2, n), ' '), occ FROM c WHERE n > 2) GROUP BY gram),
        stable AS (SELECT c.*, ext FROM c LEFT JOIN e USING (gram) WHERE n <= {max_n} AND occ >= {f} AND (ext IS NULL OR CAST(ext AS FLOAT) <= CAST(occ AS FLOAT) * CAST({s} AS FLOAT)))
        SELECT gram, n, occ, df, round(occ / words * ln(files / df), 6) AS tfidf FROM stable, total WHERE {where}"""


@query(_stable_sql(3, 5, 0.7, "true"))
def stable_ngrams(spark, d):
    return ngrams.stable_ngrams(documents(spark, d), 3, 5, 0.7)


@query(_stable_sql(3, 5, 0.7, "list_contains(string_split(gram, ' '), 'der')"))
def stable_ngrams_containing(spark, d):
    return ngrams.lookup(ngrams.stable_ngrams(documents(spark, d), 3, 5, 0.7), ["der"])


def _stable_all_sql(f: int, s: float, tok: str, surface: str = "surface", where: str = "true") -> str:
    """Grams of any length, one token longer each time, known by a hash; texts are read from one place in the end."""
    return f"""{tok}, t AS (SELECT doc_id, i, {surface} AS word, hash({surface}) AS s FROM ann),
        lv AS (SELECT doc_id, p, 2 AS n, h, count(*) OVER (PARTITION BY h) AS occ FROM (SELECT a.doc_id, a.i AS p, hash(a.s, b.s) AS h FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.i = a.i + 1)
            UNION ALL SELECT doc_id, p, n, h, count(*) OVER (PARTITION BY h) AS occ FROM (SELECT l.doc_id, l.p, l.n + 1 AS n, hash(l.h, t.s) AS h FROM lv l JOIN t ON t.doc_id = l.doc_id AND t.i = l.p + l.n WHERE l.occ >= {int(f * s) + 1})),
        many AS MATERIALIZED (SELECT * FROM lv WHERE occ > {int(f * s)}),
        c AS (SELECT h, n, any_value(occ) AS occ, count(DISTINCT doc_id) AS df, min({{d: doc_id, p: p}}) AS spot FROM many WHERE occ >= {f} GROUP BY h, n),
        e AS (SELECT h, n, max(ext) AS ext FROM (SELECT a.h, a.n, b.occ AS ext FROM many a JOIN many b ON a.doc_id = b.doc_id AND a.p = b.p AND b.n = a.n + 1
              UNION ALL SELECT a.h, a.n, b.occ FROM many a JOIN many b ON a.doc_id = b.doc_id AND a.p = b.p + 1 AND b.n = a.n + 1) GROUP BY h, n),
        stable AS (SELECT c.*, row_number() OVER () AS id FROM c LEFT JOIN e USING (h, n) WHERE ext IS NULL OR CAST(ext AS FLOAT) <= CAST(occ AS FLOAT) * CAST({s} AS FLOAT)),
        named AS (SELECT id, string_agg(word, ' ' ORDER BY i) AS gram FROM stable JOIN t ON t.doc_id = spot.d AND t.i >= spot.p AND t.i < spot.p + n GROUP BY id),
        grams AS (SELECT gram, h, n, occ, df FROM stable JOIN named USING (id) WHERE {where})"""


_TFIDF = "SELECT gram, CAST(n AS BIGINT) AS n, occ, df, round(occ / words * ln(files / df), 6) AS tfidf FROM grams, total"
_PLAIN = ", ann AS (SELECT * FROM tok)"


@query(f"WITH RECURSIVE {_stable_all_sql(5, 0.7, _tok() + _PLAIN)} {_TFIDF}")
def stable_ngrams_all(spark, d):
    """Of any length."""
    return ngrams.stable_ngrams(documents(spark, d), None, 5, 0.7)


@query(f"WITH RECURSIVE {_stable_all_sql(5, 0.7, _tok() + _PLAIN)} SELECT gram, doc_id, CAST(p AS BIGINT) AS pos FROM grams JOIN many USING (h, n)")
def stable_ngram_places(spark, d):
    """Every place of every stable n-gram of any length."""
    docs = documents(spark, d)
    return ngrams.occurrences(ngrams.stable_ngrams(docs, None, 5, 0.7), docs)


@query(f"WITH RECURSIVE {_stable_all_sql(5, 0.7, _tok() + _PLAIN)} SELECT DISTINCT a.gram, b.gram AS inside FROM grams a JOIN grams b ON b.n < a.n AND contains(' ' || a.gram || ' ', ' ' || b.gram || ' ')")
def stable_ngrams_nested(spark, d):
    """The stable n-grams inside each."""
    return ngrams.nested(ngrams.stable_ngrams(documents(spark, d), None, 5, 0.7))


_PHRASE = "released under the mit license".split()
_INSIDE = ", ".join(repr(" ".join(_PHRASE[a:b])) for a in range(5) for b in range(a + 2, 6))


@query(_stable_sql(5, 3, 0.9, f"gram IN ({_INSIDE}) AND EXISTS (SELECT 1 FROM stable WHERE gram = '{' '.join(_PHRASE)}')"))
def stable_ngram_lookup_nested(spark, d):
    return ngrams.lookup(ngrams.stable_ngrams(documents(spark, d), 5, 3, 0.9), _PHRASE)


_FOLD = "fold AS (SELECT a.*, CASE key WHEN 'be/VERB' THEN 'der/ADJF' WHEN 'will/NOUN' THEN 'to/PREP' ELSE key END AS folded FROM ann a)"


def _pattern_sql(fold: bool) -> str:
    source = _FOLD if fold else "fold AS (SELECT a.*, key AS folded FROM ann a)"
    lemma = lambda k, x: f"(folded{k} = '{x}' OR form_key{k} = '{x}')"
    has = lambda k, g: f"list_contains(string_split(grammemes{k}, ' '), '{g}')"
    tests = [
        ("be NOUN", 2, f"{lemma(0, 'be/VERB')} AND {has(1, 'NOUN')}"), ("der any", 2, lemma(0, "der/ADJF")), ("the was", 2, "surface0 = 'the' AND surface1 = 'was'"),
        ("past VERB PREP", 2, f"{has(0, 'VERB')} AND {has(0, 'past')} AND {has(1, 'PREP')}"), ("never", 1, lemma(0, "?no such lemma")),
    ]
    columns = ", ".join(f"{c} AS {c}0, lead({c}) OVER w AS {c}1" for c in ("surface", "form_key", "grammemes", "folded"))
    hits = " UNION ALL ".join(f"SELECT '{name}' AS model, doc_id, i AS pos, {'surface0' if m == 1 else chr(32).join(['surface0', '||', repr(' '), '||', 'surface1'])} AS forms FROM win WHERE i + {m} < n AND {t}" for name, m, t in tests)
    return f"WITH {_tok()}, {_ANN}, {source}, win AS (SELECT doc_id, i, n, {columns} FROM fold WINDOW w AS (PARTITION BY doc_id ORDER BY i)), hits AS ({hits})"


@query(_pattern_sql(False) + " SELECT * FROM hits")
def pattern_match_hits(spark, d):
    return patterns.pattern_hits(documents(spark, d), MODELS, toy(spark))


@query(_pattern_sql(True) + " SELECT * FROM hits")
def pattern_synonyms(spark, d):
    return patterns.pattern_hits(documents(spark, d), MODELS, toy(spark), toy_thesaurus(spark))


@query(_pattern_sql(True) + f""" SELECT m.model, count(h.doc_id) AS freq, count(DISTINCT h.doc_id) AS texts,
    CASE WHEN count(h.doc_id) > 0 THEN round(count(h.doc_id) / any_value(words) * ln(any_value(files) / count(DISTINCT h.doc_id)), 6) END AS tfidf
    FROM {_values([(name,) for name, _ in MODELS])} m(model) LEFT JOIN hits h ON m.model = h.model, total GROUP BY m.model""")
def pattern_match_tfidf(spark, d):
    return patterns.pattern_stats(documents(spark, d), MODELS, toy(spark), toy_thesaurus(spark))


def _bm25_sql(terms: list[str], ann: bool) -> str:
    source = f", {_ANN}" if ann else ", ann AS (SELECT *, surface AS key FROM tok)"
    return f"""WITH {_tok()}{source}, tf AS (SELECT key, doc_id, count(*) AS tf, any_value(n) AS n FROM ann WHERE key IN ({', '.join(f"'{t}'" for t in terms)}) GROUP BY key, doc_id),
        df AS (SELECT key, count(*) AS df FROM tf GROUP BY key)
        SELECT doc_id, score FROM (SELECT doc_id, round(sum(ln((files - df + 0.5) / (df + 0.5)) * (tf * 3.0 / (tf + 2.0 * (0.25 + 0.75 * n / (words / files))))), 6) AS score FROM tf JOIN df USING (key), total GROUP BY doc_id) WHERE score > 0"""


@query(_bm25_sql(["der", "die", "und", "la", "the"], False))
def bm25_search(spark, d):
    return search.bm25(documents(spark, d), "Der die und la the")


@query(_bm25_sql(["der/ADJF", "be/VERB", "will/NOUN", "?est"], True))
def bm25_search_expanded(spark, d):
    return search.bm25(documents(spark, d), "die the est", toy(spark), toy_thesaurus(spark))


def _index(spark: SparkSession, d: str, dictionary: morphology.Dictionary | None = None) -> index.Index:
    return index.build_index(documents(spark, d), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", dictionary)


@query(_bm25_sql(["der/ADJF", "be/VERB", "will/NOUN", "?est"], True))
def index_bm25(spark, d):
    """From a stored index, read by the query's lexemes."""
    return index.bm25(_index(spark, d, toy(spark)), "die the est", toy_thesaurus(spark))


@query(_bm25_sql(["der", "die", "und", "la", "the"], False) + " ORDER BY score DESC, doc_id LIMIT 25")
def index_bm25_best(spark, d):
    """The 25 best by block maxima."""
    return index.best(_index(spark, d), "Der die und la the", 25)[0]


@query(f"WITH {_tok()} SELECT doc_id, CAST(p - 1 AS BIGINT) AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM docs WHERE len(w) > 2) WHERE w[p] = 'the' AND w[p + 1] = 'the' AND w[p + 2] = 'of'")
def index_phrase_positions(spark, d):
    """Position lists of an index intersected."""
    return index.phrase_places(_index(spark, d), "the the of")


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return C.token_table(documents(spark, d)).select("surface").distinct()


@query(f"""WITH RECURSIVE {_tok()}, v AS (SELECT DISTINCT surface FROM tok),
    e AS (SELECT surface AS child, left(surface, length(surface) - 1) AS parent FROM v WHERE length(surface) > 1 AND length(surface) % 5 <> 0 AND left(surface, length(surface) - 1) IN (SELECT surface FROM v)),
    up(lexeme_id, node) AS (SELECT child, parent FROM e UNION SELECT lexeme_id, parent FROM up JOIN e ON node = child)
    SELECT DISTINCT lexeme_id, node AS root_id FROM up WHERE node NOT IN (SELECT child FROM e)""")
def dict_link_roots(spark, d):
    """The documents' words: each is the child of the word without its last letter; links from every fifth length don't merge."""
    words = vocabulary(spark, d)
    links = words.where("length(surface) > 1").select(F.expr("left(surface, length(surface) - 1)").alias("src"), F.col("surface").alias("dst"), F.expr("if(length(surface) % 5 = 0, 7, 3)").alias("type"))
    return morphology.link_roots(links.join(words.select(F.col("surface").alias("src")), "src", "left_semi"))


@query(f"WITH {_tok()}, {_ANN} SELECT DISTINCT surface, form_lemma, form_pos, grammemes, lemma, pos FROM ann")
def dict_disambiguate(spark, d):
    rows = morphology.annotate(vocabulary(spark, d), toy(spark))
    return rows.select("surface", "form_lemma", "form_pos", F.array_join(F.array_sort("grammemes"), " ").alias("grammemes"), "lemma", "pos")


@query(f"""WITH {_tok()}, lex AS (SELECT DISTINCT surface, length(surface) % 2 AS odd FROM tok), keys AS (SELECT surface, surface AS k, odd FROM lex UNION SELECT surface, translate(surface, 'ёЁ', 'еЕ'), odd FROM lex),
    list AS (SELECT lemma, turn, count(*) AS freq FROM (SELECT unnest({T.sql_tokens('text')}) AS lemma, turn FROM conversations) GROUP BY lemma, turn)
    SELECT surface AS lexeme_id, CAST(arg_max(freq, turn) AS DOUBLE) AS freq FROM keys JOIN list ON k = lemma AND odd = turn % 2 GROUP BY surface""")
def dict_frequency_overlay(spark, d):
    """The documents' words as nouns or, of odd length, verbs; the conversations' counts of each turn as the list, verbs in odd turns: the last turn counts."""
    words = vocabulary(spark, d)
    lexemes = words.select(F.col("surface").alias("lexeme_id"), F.col("surface").alias("lemma"), F.expr("if(length(surface) % 2 = 1, 'INFN', 'NOUN')").alias("pos"))
    turns = C.token_table(spark.read.parquet(f"{d}/conversations.parquet").select(F.col("turn").alias("doc_id"), "text"))
    listed = turns.groupBy(F.col("surface").alias("lemma"), F.col("doc_id").cast("long").alias("line")).agg(F.count(F.lit(1)).cast("float").alias("freq"))
    listed = listed.withColumn("list_pos", F.expr("if(line % 2 = 1, 'v', 's')"))
    dictionary = dataclasses.replace(morphology.Dictionary.empty(spark), lexemes=lexemes, frequencies=listed)
    return dictionary.lexeme_freq().select("lexeme_id", F.col("freq").cast("double").alias("freq"))


@query(f"""WITH {_tok()}, f AS (SELECT DISTINCT translate(surface, 'eE', 'ёЁ') AS form FROM tok)
    SELECT form AS "key", form, 0 AS yo FROM f UNION ALL SELECT translate(form, 'ёЁ', 'еЕ'), form, 1 FROM f WHERE contains(form, 'ё') OR contains(form, 'Ё')""")
def dict_yo_keys(spark, d):
    """The documents' words, written with ё for e."""
    forms = vocabulary(spark, d).select(F.translate("surface", "eE", "ёЁ").alias("form")).distinct()
    return dataclasses.replace(morphology.Dictionary.empty(spark), forms=forms).form_keys().select("key", "form", "yo")


@query(f"""WITH f AS ({_frequency_sql("true", True)})
    SELECT lemma, pos, (CASE WHEN length(lemma) > 20 THEN left(lemma, 19) || '…' ELSE rpad(lemma, 20, ' ') END) || rpad(pos, 8, ' ') || lpad(format('{{:.6f}}', ipm), 16, ' ') || lpad(CAST(texts AS VARCHAR), 8, ' ') AS line FROM f""")
def report_format(spark, d):
    return report.frequency_lines(frequency.frequency_list(documents(spark, d), toy(spark), ordered=False))


#: A dictionary in which two lexemes share lemma and part of speech ('la', 'der'), words are inflected and links lead to a root.
LEXEMES_2 = [
    (1, "the", "PRCL", ["PRCL"]), (2, "of", "PREP", ["PREP"]), (4, "was", "VERB", ["VERB"]), (5, "be", "INFN", ["INFN"]), (12, "being", "GRND", ["GRND"]), (20, "la", "NOUN", ["NOUN"]), (21, "la", "NOUN", ["NOUN"]),
    (22, "der", "NOUN", ["NOUN"]), (23, "der", "NOUN", ["NOUN"]), (24, "dié", "VERB", ["VERB"]),
]
FORMS_2 = [
    (1, 0, "the", ["PRCL"]), (2, 0, "of", ["PREP"]), (4, 0, "was", ["VERB", "past"]), (4, 1, "is", ["VERB", "pres"]), (5, 0, "be", ["INFN"]), (5, 1, "to", ["INFN"]), (12, 0, "ing", ["GRND"]), (20, 0, "la", ["NOUN"]),
    (20, 1, "en", ["NOUN"]), (21, 0, "la", ["NOUN"]), (21, 1, "el", ["NOUN", "masc"]), (22, 0, "der", ["NOUN"]), (22, 1, "und", ["NOUN"]), (23, 0, "die", ["NOUN", "femn"]), (24, 0, "die", ["VERB"]), (24, 1, "und", ["VERB"]),
]
LINKS_2 = [(5, 4, 3), (4, 12, 4), (1, 2, 7)]
FREQUENCIES_2 = [("be", "v", 700.0, 0), ("la", "s", 5.0, 1), ("der", "s", 30.0, 2), ("dié", "VERB", 3.0, 3), ("was", "VERB", 9.0, 4)]
THESAURUS_2 = [("is", "die", 0), ("is", "el", 1), ("und", "est", 2)]
MODELS_2 = [
    ("inflected", [{"lemma": "was"}]), ("synonym of inflected", [{"lemma": "ing"}, {"grammemes": ["PREP"]}]), ("one der", [{"lemma": "und"}, {}]), ("form", [{"wordform": "en"}, {"lemma": "la"}]), ("unknown", [{"lemma": "est"}]),
]


def homonyms(spark: SparkSession) -> morphology.Dictionary:
    return morphology.Dictionary.of(spark, LEXEMES_2, FORMS_2, LINKS_2, FREQUENCIES_2)


def _resolution_sql() -> str:
    """CTEs up to res: the resolution of surfaces, worked out from the dictionary's own rows."""
    from korpusflow.sources.resources import LIST_POS, MERGING_LINKS

    names = ", ".join(f"('{a}', '{b}')" for a, b in LIST_POS.items())
    return f"""lex AS (SELECT * FROM {_values([r[:3] for r in LEXEMES_2])} r(lexeme_id, lemma, pos)),
        frm AS (SELECT * FROM {_values([(*r[:3], ' '.join(r[3])) for r in FORMS_2])} r(lexeme_id, f_idx, form, grammemes)),
        lnk AS (SELECT dst AS child, src AS parent FROM {_values(LINKS_2)} r(src, dst, type) WHERE type IN {MERGING_LINKS}),
        frq AS (SELECT lemma, coalesce(p.b, f.tag) AS pos, freq, line FROM {_values(FREQUENCIES_2)} f(lemma, tag, freq, line) LEFT JOIN (VALUES {names}) p(a, b) ON f.tag = p.a),
        lkey AS (SELECT lexeme_id, lemma AS k, pos FROM lex UNION SELECT lexeme_id, translate(lemma, 'ёЁ', 'еЕ'), pos FROM lex),
        lfrq AS (SELECT lexeme_id, arg_max(freq, line) AS freq FROM frq JOIN lkey ON frq.lemma = lkey.k AND frq.pos = lkey.pos GROUP BY lexeme_id),
        up AS (SELECT child, parent FROM lnk UNION SELECT up.child, lnk.parent FROM up JOIN lnk ON up.parent = lnk.child),
        rts AS (SELECT child, parent, coalesce(freq, 0) AS freq, row_number() OVER (PARTITION BY child ORDER BY coalesce(freq, 0) DESC, parent) AS k FROM up LEFT JOIN lfrq ON parent = lexeme_id WHERE parent NOT IN (SELECT child FROM lnk)),
        rsd AS (SELECT l.lexeme_id, coalesce(r.parent, l.lexeme_id) AS resolved_id, coalesce(r.freq, f.freq, 0) AS freq FROM lex l LEFT JOIN (SELECT * FROM rts WHERE k = 1) r ON l.lexeme_id = r.child LEFT JOIN lfrq f ON l.lexeme_id = f.lexeme_id),
        fkey AS (SELECT form AS k, 0 AS yo, * FROM frm UNION ALL SELECT translate(form, 'ёЁ', 'еЕ'), 1, * FROM frm WHERE form LIKE '%ё%' OR form LIKE '%Ё%'),
        res AS (SELECT k AS surface, form, f_idx, f.lexeme_id AS form_lexeme_id, o.lemma AS form_lemma, o.pos AS form_pos, grammemes, r.resolved_id AS lexeme_id, t.lemma, t.pos
                FROM fkey f JOIN rsd r ON f.lexeme_id = r.lexeme_id JOIN lex o ON f.lexeme_id = o.lexeme_id JOIN lex t ON r.resolved_id = t.lexeme_id
                QUALIFY row_number() OVER (PARTITION BY k ORDER BY freq DESC, f.lexeme_id, yo, f_idx) = 1)"""


#: ann: each token with its lexeme; `key` tells lexemes apart, unknown words by themselves.
_ANN_2 = f"""{_resolution_sql()}, ann AS (SELECT t.*, coalesce(r.lemma, surface) AS lemma, coalesce(r.pos, 'UNKN') AS pos, coalesce(CAST(r.lexeme_id AS VARCHAR), '?' || surface) AS key,
        coalesce(CAST(form_lexeme_id AS VARCHAR), '?' || surface) AS form_key, coalesce(grammemes, '') AS grammemes, form_pos, form FROM tok t LEFT JOIN res r USING (surface))"""


def _key(word: str) -> str:
    return f"coalesce((SELECT CAST(lexeme_id AS VARCHAR) FROM res WHERE surface = '{word}'), '?{word}')"


_SYN_2 = f"syn AS (SELECT {{}} FROM {_values(THESAURUS_2)} r(head, synonym, ord) LEFT JOIN res h ON head = h.surface LEFT JOIN res s ON synonym = s.surface)".format(
    "coalesce(CAST(h.lexeme_id AS VARCHAR), '?' || head) AS head, coalesce(CAST(s.lexeme_id AS VARCHAR), '?' || synonym) AS synonym, ord"
)


@query(f"WITH RECURSIVE {_tok()}, {_resolution_sql()} SELECT surface, form, CAST(form_lexeme_id AS BIGINT) AS form_lexeme_id, form_pos, CAST(lexeme_id AS BIGINT) AS lexeme_id, lemma, pos FROM res WHERE surface IN (SELECT surface FROM tok)")
def dict_resolution(spark, d):
    """What the dictionary makes of those of the documents' words that it has."""
    return vocabulary(spark, d).join(homonyms(spark).resolution(), "surface").select("surface", "form", "form_lexeme_id", "form_pos", "lexeme_id", "lemma", "pos")


@query(f"""WITH RECURSIVE {_tok()}, {_ANN_2} SELECT CAST(key AS BIGINT) AS lexeme_id, any_value(lemma) AS lemma, any_value(pos) AS pos, count(*) AS occ, round(count(*) * 1e6 / any_value(words), 6) AS ipm, count(DISTINCT doc_id) AS texts
    FROM ann, total WHERE pos <> 'UNKN' GROUP BY key""")
def lemma_frequency_homonyms(spark, d):
    return frequency.frequency_list(documents(spark, d), homonyms(spark), frequency.known, ids=True)


@query(f"""WITH RECURSIVE {_tok()}, {_ANN_2}, near AS (SELECT doc_id, key, lag(key) OVER w AS lk, lag(lemma) OVER w AS ll, lead(key) OVER w AS rk, lead(lemma) OVER w AS rl FROM ann WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT "left", "right", freq FROM (SELECT any_value(ll) AS "left", '' AS "right", count(*) AS freq FROM near WHERE key = {_key('und')} AND lk IS NOT NULL GROUP BY lk
    UNION ALL SELECT '', any_value(rl), count(*) FROM near WHERE key = {_key('und')} AND rk IS NOT NULL GROUP BY rk) WHERE freq >= 2""")
def concordance_homonyms(spark, d):
    return concordance.concordance(documents(spark, d), "und", 1, 2, "all", homonyms(spark))


@query(f"""WITH RECURSIVE {_tok()}, {_ANN_2}, {_SYN_2}, head AS (SELECT synonym, arg_max(head, ord) AS head FROM syn GROUP BY synonym),
    fold AS (SELECT a.*, coalesce(h.head, a.key) AS folded FROM ann a LEFT JOIN head h ON a.key = h.synonym),
    win AS (SELECT doc_id, i, n, folded, form_key, form, lead(folded) OVER w AS folded1, lead(form_key) OVER w AS form_key1, lead(grammemes) OVER w AS grammemes1 FROM fold WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    hits AS (SELECT 'inflected' AS model, doc_id FROM win WHERE i + 1 < n AND {_key('was')} IN (folded, form_key)
      UNION ALL SELECT 'synonym of inflected', doc_id FROM win WHERE i + 2 < n AND {_key('ing')} IN (folded, form_key) AND list_contains(string_split(grammemes1, ' '), 'PREP')
      UNION ALL SELECT 'one der', doc_id FROM win WHERE i + 2 < n AND {_key('und')} IN (folded, form_key)
      UNION ALL SELECT 'form', doc_id FROM win WHERE i + 2 < n AND form = 'en' AND {_key('la')} IN (folded1, form_key1)
      UNION ALL SELECT 'unknown', doc_id FROM win WHERE i + 1 < n AND {_key('est')} IN (folded, form_key))
    SELECT m.model, count(h.doc_id) AS freq, count(DISTINCT h.doc_id) AS texts, CASE WHEN count(h.doc_id) > 0 THEN round(count(h.doc_id) / any_value(words) * ln(any_value(files) / count(DISTINCT h.doc_id)), 6) END AS tfidf
    FROM {_values([(name,) for name, _ in MODELS_2])} m(model) LEFT JOIN hits h ON m.model = h.model, total GROUP BY m.model""")
def pattern_homonyms(spark, d):
    return patterns.pattern_stats(documents(spark, d), MODELS_2, homonyms(spark), spark.createDataFrame(THESAURUS_2, "head string, synonym string, ord long"))


@query(f"""WITH RECURSIVE {_tok()}, {_ANN_2}, {_SYN_2}, own AS (SELECT DISTINCT {_key('und')} AS key UNION SELECT {_key('to')}), terms AS (SELECT key FROM own UNION SELECT synonym FROM syn JOIN own ON syn.head = own.key),
    tf AS (SELECT key, doc_id, count(*) AS tf, any_value(n) AS n FROM ann JOIN terms USING (key) GROUP BY key, doc_id), df AS (SELECT key, count(*) AS df FROM tf GROUP BY key)
    SELECT doc_id, score FROM (SELECT doc_id, round(sum(ln((files - df + 0.5) / (df + 0.5)) * (tf * 3.0 / (tf + 2.0 * (0.25 + 0.75 * n / (words / files))))), 6) AS score FROM tf JOIN df USING (key), total GROUP BY doc_id) WHERE score > 0""")
def bm25_homonyms(spark, d):
    return search.bm25(documents(spark, d), "und the to", homonyms(spark), spark.createDataFrame(THESAURUS_2, "head string, synonym string, ord long"))


@query(f"WITH RECURSIVE {_stable_all_sql(5, 0.7, _tok() + ', ' + _ANN_2, 'lemma')} {_TFIDF}")
def stable_ngrams_homonyms(spark, d):
    """A gram is its lemmas: 'la' of two lexemes is one."""
    return ngrams.stable_ngrams(documents(spark, d), None, 5, 0.7, homonyms(spark))


_CONV = _tok("conversations", "CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)")


@query(_frequency_sql("true", False, _CONV))
def conversations_frequency(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet").withColumn("key", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return frequency.frequency_list(C.table_corpus(t, "key", "text"))


@query(f"WITH {_tok('pages', 'page_id', chr(114) + 'egexp_replace(html, ' + repr('<[^>]*>') + ', ' + repr(' ') + ', ' + repr('g') + ')')} SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens FROM docs")
def pages_doc_lengths(spark, d):
    t = spark.read.parquet(f"{d}/pages.parquet").withColumn("plain", F.regexp_replace("html", "<[^>]*>", " "))
    return C.lengths(C.table_corpus(t, "page_id", "plain"))


@query("SELECT CAST(item_id AS BIGINT) AS item_id, translate(text, '<>:\"/\\|?* ', '__________') AS file_name FROM benchmark")
def file_names(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", T.file_name(F.col("text")).alias("file_name"))


@query(f"WITH f AS ({_frequency_sql('true', False)}) SELECT *, row_number() OVER (ORDER BY occ DESC, lemma) AS rank FROM f")
def lemma_frequency_ranked(spark, d):
    return ranks.ranked(frequency.frequency_list(documents(spark, d), ordered=False), F.desc("occ"), "lemma")


@query(f'WITH c AS ({_concordance_sql(["the", "the"], 2, 2, "b = 0", False)}) SELECT *, row_number() OVER (ORDER BY freq DESC, "left", "right") AS rank FROM c')
def concordance_ranked(spark, d):
    return ranks.ranked(concordance.concordance(documents(spark, d), "the the", 2, 2, "left", ordered=False), F.desc("freq"), "left", "right")


@query(f"WITH s AS ({_bm25_sql(['der', 'die', 'und', 'la', 'the'], False)}) SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s")
def bm25_ranked(spark, d):
    return ranks.ranked(search.bm25(documents(spark, d), "Der die und la the"), F.desc("score"), "doc_id")



@query(f"""WITH {_tok()}, conv AS (SELECT {T.sql_tokens('text')} AS w, row_number() OVER () AS doc_id FROM conversations),
    every AS (SELECT surface, 'd' || doc_id AS doc FROM tok UNION ALL SELECT unnest(w), 'c' || doc_id FROM conv),
    u AS (SELECT surface, count(*) AS occ, count(DISTINCT doc) AS texts FROM every WHERE surface NOT IN ({", ".join(f"'{r[0]}'" for r in RESOLUTION)}) GROUP BY surface),
    a AS (SELECT translate(surface, 'ёЁ', 'еЕ') AS alias, min(surface) AS surface FROM u WHERE surface <> translate(surface, 'ёЁ', 'еЕ') GROUP BY alias)
    SELECT u.surface, occ, texts, a.alias FROM u LEFT JOIN a ON u.surface = a.surface AND a.alias NOT IN (SELECT surface FROM u)""")
def unknown_words(spark, d):
    """The unknown words of the documents, then those of the conversations added to them."""
    dictionary = toy(spark)
    words = unknown.merged(None, unknown.counts(documents(spark, d), dictionary))
    words = unknown.merged(words, unknown.counts(spark.read.parquet(f"{d}/conversations.parquet").select("text"), dictionary))
    named = unknown.aliases(words, dictionary).select("surface", "alias")
    return words.join(named, "surface", "left").select("surface", "occ", "texts", "alias")
