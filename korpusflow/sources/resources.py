"""Dictionary, frequency list, thesaurus and pattern files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_G = "ARRAY<STRUCT<_v: STRING>>"
LEMMA = f"_id LONG, l STRUCT<_t: STRING, g: {_G}>, f ARRAY<STRUCT<_t: STRING, g: {_G}>>"
LINK = "_from LONG, _to LONG, _type INT"
SYNSET = "_l STRING, synonym ARRAY<STRUCT<_l: STRING>>"
MODEL = f"_name STRING, token ARRAY<STRUCT<_lemma: STRING, _wordform: STRING, g: {_G}>>"
#: Link types that make one lexeme a form of another (fixed values).
MERGING_LINKS = (0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 13, 14, 21, 22, 24, 25, 27)
#: Part-of-speech tags in their sort order, the unknown one last (fixed values).
POS_ORDER = ("NOUN", "ADJF", "ADJS", "COMP", "VERB", "INFN", "PRTF", "PRTS", "GRND", "NUMR", "ADVB", "NPRO", "PRED", "PREP", "CONJ", "PRCL", "INTJ", "UNKN")
#: Frequency lists' tags and what they mean (fixed values).
LIST_POS = {
    "s": "NOUN", "s.PROP": "NOUN", "a": "ADJF", "num": "NUMR", "anum": "ADJF", "v": "INFN", "adv": "ADVB", "spro": "NPRO", "apro": "ADJF", "advpro": "ADVB",
    "pr": "PREP", "conj": "CONJ", "part": "PRCL", "intj": "INTJ", "init": "NOUN",
}
#: Function words' parts of speech (fixed values).
FUNCTION_POS = ("NPRO", "PREP", "CONJ", "PRCL", "INTJ")

#: The dictionary's grammemes (fixed values): parts of speech, names of categories, then the rest.
GRAMMEMES = tuple(
    """POST NOUN ADJF ADJS COMP VERB INFN PRTF PRTS GRND NUMR ADVB NPRO PRED PREP CONJ PRCL INTJ
    ANim GNdr NMbr CAse ASpc TRns PErs TEns MOod INvl VOic
    anim inan masc femn neut ms-f sing plur nomn gent datv accs ablt loct voct gen1 gen2 acc2 loc1 loc2
    perf impf tran intr 1per 2per 3per pres past futr indc impr incl excl actv pssv
    Sgtm Pltm Fixd Abbr Name Surn Patr Geox Orgn Trad Subx Supr Qual Apro Anum Poss V-ey V-oy Cmp2 V-ej
    Impe Impx Mult Refl Infr Slng Arch Litr Erro Dist Ques Dmns Prnt V-be V-en V-ie V-bi Fimp Prdx Coun Coll V-sh Af-p
    Inmx Vpre Anph Init Adjx Ms-f Hypo""".split()
)


def strange_tags(lexemes: DataFrame, forms: DataFrame, frequencies: DataFrame) -> DataFrame:
    """kind ('grammeme', 'part of speech' or 'list tag'), tag, n: what the tables above don't know."""
    tags = lexemes.select(F.explode("grammemes").alias("tag")).unionByName(forms.select(F.explode("grammemes").alias("tag"))).where(~F.col("tag").isin(*GRAMMEMES))
    pos = lexemes.select(F.col("pos").alias("tag")).where(~F.col("tag").isin(*POS_ORDER))
    listed = frequencies.select(F.col("list_pos").alias("tag")).where(~F.col("tag").isin(*LIST_POS, *POS_ORDER[:-1]))
    kinds = (("grammeme", tags), ("part of speech", pos), ("list tag", listed))
    from functools import reduce

    return reduce(DataFrame.unionByName, (df.select(F.lit(kind).alias("kind"), "tag") for kind, df in kinds)).groupBy("kind", "tag").agg(F.count(F.lit(1)).alias("n"))


def _tags(g):
    return F.coalesce(F.transform(g, lambda x: x["_v"]), F.array().cast("array<string>"))


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def dictionary_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lexemes(lexeme_id, lemma, pos, grammemes), forms(lexeme_id, f_idx, form, grammemes), links(src, dst, type)."""
    raw = _xml(spark, path, "lemma", LEMMA).where("l is not null").withColumn("own", _tags(F.col("l.g")))
    lexemes = raw.select(F.col("_id").alias("lexeme_id"), F.col("l._t").alias("lemma"), F.coalesce(F.get("own", F.lit(0)), F.lit("UNKN")).alias("pos"), F.col("own").alias("grammemes"))
    forms = raw.select(F.col("_id").alias("lexeme_id"), "own", F.posexplode("f").alias("f_idx", "f")).select("lexeme_id", "f_idx", F.col("f._t").alias("form"), F.array_union("own", _tags(F.col("f.g"))).alias("grammemes"))
    links = _xml(spark, path, "link", LINK).select(F.col("_from").alias("src"), F.col("_to").alias("dst"), F.col("_type").alias("type"))
    return lexemes, forms, links


def frequency_tsv(spark: SparkSession, path: str) -> DataFrame:
    """lemma, list_pos, freq, line: columns after the third are ignored; later lines are later rows."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    lemma, pos, freq = rows.columns[:3]
    return rows.select(F.col(lemma).alias("lemma"), F.col(pos).alias("list_pos"), F.col(freq).cast("float").alias("freq"), F.monotonically_increasing_id().alias("line"))


def thesaurus_xml(spark: SparkSession, path: str) -> DataFrame:
    """head, synonym, ord (order in the file)."""
    raw = _xml(spark, path, "synset", SYNSET).withColumn("n", F.monotonically_increasing_id())
    return raw.select(F.col("_l").alias("head"), "n", F.posexplode("synonym").alias("k", "s")).select("head", F.col("s._l").alias("synonym"), (F.col("n") * 100000 + F.col("k")).alias("ord"))


def models_xml(spark: SparkSession, path: str) -> list[tuple[str, list[dict]]]:
    """Patterns: name, tokens; a token has lemma, wordform, grammemes, each None or empty if free.  A few rows: a driver-side list."""
    rows = _xml(spark, path, "model", MODEL).collect()
    return [(r._name, [{"lemma": t and t._lemma, "wordform": t and t._wordform, "grammemes": [g._v for g in (t and t.g) or []]} for t in r.token or []]) for r in rows]
