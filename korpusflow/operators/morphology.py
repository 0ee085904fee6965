"""Dictionary operators: link roots, frequencies, keys, disambiguation, annotation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korpusflow.functions.text import deyotized
from korpusflow.sources import snapshots
from korpusflow.sources.corpus import cut, token_table
from korpusflow.sources.resources import FUNCTION_POS, LIST_POS, MERGING_LINKS, strange_tags

UNKNOWN = "UNKN"
TABLES = ("lexemes", "forms", "links", "frequencies")


def link_roots(links: DataFrame) -> DataFrame:
    """lexeme_id, root_id: the ancestors without parents, over merging links (child `dst` of parent `src`).

    Paths double in length each round until no pair of lexeme and ancestor is
    new, which ends cycles too: chains of any length are followed.  A lexeme
    that leads into cycles only has no root.
    """
    edges = cut(links.where(F.col("type").isin(*MERGING_LINKS)).select(F.col("dst").alias("lexeme_id"), F.col("src").alias("node")).where("lexeme_id != node").distinct())
    reach, n = edges, edges.count()
    while n:
        further = reach.select(F.col("lexeme_id").alias("node"), F.col("node").alias("root_id"))
        reach = cut(reach.unionByName(reach.join(further, "node").select("lexeme_id", F.col("root_id").alias("node"))).distinct())
        before, n = n, reach.count()
        if n == before:
            break
    return reach.join(edges.select(F.col("lexeme_id").alias("node")).distinct(), "node", "left_anti").select("lexeme_id", F.col("node").alias("root_id"))


def _keys(df: DataFrame, column: str) -> DataFrame:
    """key, yo: each row under its own spelling and, if that has ё, under its spelling with е."""
    own = df.withColumn("key", F.col(column)).withColumn("yo", F.lit(0))
    return own.unionByName(df.where(F.col(column).rlike("[ёЁ]")).withColumn("key", deyotized(F.col(column))).withColumn("yo", F.lit(1)))


@dataclass
class Dictionary:
    """lexemes(lexeme_id, lemma, pos, grammemes), forms(lexeme_id, f_idx, form, grammemes), links(src, dst, type), frequencies(lemma, list_pos, freq, line)."""

    lexemes: DataFrame
    forms: DataFrame
    links: DataFrame
    frequencies: DataFrame
    #: Words without a form that some corpus had (operators.unknown), and what they make of query surfaces.
    unknown: DataFrame | None = None

    @classmethod
    def empty(cls, spark: SparkSession) -> Dictionary:
        return cls.of(spark, [], [], [], [])

    @classmethod
    def of(cls, spark: SparkSession, lexemes: list, forms: list, links: list, frequencies: list) -> Dictionary:
        return cls(
            spark.createDataFrame(lexemes, "lexeme_id long, lemma string, pos string, grammemes array<string>"),
            spark.createDataFrame(forms, "lexeme_id long, f_idx int, form string, grammemes array<string>"),
            spark.createDataFrame(links, "src long, dst long, type int"),
            spark.createDataFrame(frequencies, "lemma string, list_pos string, freq float, line long"),
        )

    def form_keys(self) -> DataFrame:
        return _keys(self.forms, "form")

    def lexeme_freq(self) -> DataFrame:
        """lexeme_id, freq: the list's last row for each lexeme by lemma key and part of speech."""
        names = F.create_map(*(F.lit(x) for kv in LIST_POS.items() for x in kv))
        rows = self.frequencies.withColumn("pos", F.coalesce(F.try_element_at(names, F.col("list_pos")), F.col("list_pos")))
        lex = _keys(self.lexemes.select("lexeme_id", F.col("lemma").alias("own"), F.col("pos").alias("own_pos")), "own")
        hit = rows.join(lex, (F.col("lemma") == F.col("key")) & (F.col("pos") == F.col("own_pos")))
        return hit.groupBy("lexeme_id").agg(F.max_by("freq", "line").alias("freq"))

    def resolved(self) -> DataFrame:
        """Computed once and kept: lexeme_id, resolved_id, freq: a lexeme with roots is its most frequent root (ties: the lowest id), else itself."""
        if (known := self.__dict__.get("_resolved")) is not None:
            return known
        freq = self.lexeme_freq()
        roots = link_roots(self.links).join(freq.withColumnRenamed("lexeme_id", "root_id"), "root_id", "left").withColumn("freq", F.coalesce("freq", F.lit(0.0).cast("float")))
        best = roots.groupBy("lexeme_id").agg(F.max(F.struct("freq", (-F.col("root_id")).alias("minus"))).alias("b")).select("lexeme_id", (-F.col("b.minus")).alias("root_id"), F.col("b.freq").alias("root_freq"))
        own = self.lexemes.select("lexeme_id").join(freq, "lexeme_id", "left").join(best, "lexeme_id", "left")
        self._resolved = cut(own.select("lexeme_id", F.coalesce("root_id", "lexeme_id").alias("resolved_id"), F.coalesce("root_freq", "freq", F.lit(0.0).cast("float")).alias("freq")))
        return self._resolved

    def resolution(self) -> DataFrame:
        """surface -> form, f_idx, form_lexeme_id, form_lemma, form_pos, grammemes, lexeme_id, lemma, pos: one row for each key; computed once and kept.

        Of a key's forms the one whose resolved lexeme is the most frequent; of
        equals the first: lexemes in order, own spellings before those with е for ё.
        """
        if (known := self.__dict__.get("_resolution")) is not None:
            return known
        lexemes = self.lexemes.select("lexeme_id", "lemma", "pos")
        rows = (
            self.form_keys().join(self.resolved(), "lexeme_id").join(lexemes.select("lexeme_id", F.col("lemma").alias("form_lemma"), F.col("pos").alias("form_pos")), "lexeme_id")
            .join(lexemes.select(F.col("lexeme_id").alias("resolved_id"), "lemma", "pos"), "resolved_id")
        )
        first = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("freq"), "lexeme_id", "yo", "f_idx"))
        self._resolution = cut(rows.withColumn("k", first).where("k = 1").select(F.col("key").alias("surface"), "form", "f_idx", F.col("lexeme_id").alias("form_lexeme_id"), "form_lemma", "form_pos", "grammemes", F.col("resolved_id").alias("lexeme_id"), "lemma", "pos"))
        return self._resolution

    def knowing(self, unknown: DataFrame, aliases: DataFrame) -> Dictionary:
        """The dictionary with unknown words as lexemes of their own and other spellings of them: to look queries up.

        Texts are looked up without it: there each unknown surface is its own lexeme anyway, and this table is as large as their vocabulary.
        """
        out = Dictionary(self.lexemes, self.forms, self.links, self.frequencies, unknown)
        own = {name: c for name, c in unknown_columns("to").items() if name not in ("form_lexeme_id", "lexeme_id")}
        rows = unknown.select("surface", F.col("surface").alias("to"), "lexeme_id").unionByName(aliases.select(F.col("alias").alias("surface"), F.col("surface").alias("to"), "lexeme_id"))
        rows = rows.select("surface", F.col("lexeme_id").alias("form_lexeme_id"), "lexeme_id", *(c.alias(name) for name, c in own.items()))
        out._resolved, out._resolution = self.resolved(), self.resolution().unionByName(rows)
        return out

    def check(self) -> None:
        """Refuses a dictionary with grammemes, parts of speech or list tags that aren't known."""
        if bad := strange_tags(self.lexemes, self.forms, self.frequencies).orderBy("kind", "tag").limit(20).collect():
            raise ValueError("unknown tags: " + ", ".join(f"{r.kind} {r.tag} ({r.n})" for r in bad))

    def save(self, path: str) -> None:
        """A new version of the snapshot: the four tables and what they resolve to; unknown words have a table of their own (operators.unknown)."""
        tables = {name: getattr(self, name) for name in TABLES} | {"resolved": self.resolved(), "resolution": self.resolution()}
        snapshots.publish(self.lexemes.sparkSession, path, tables)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dictionary:
        """The newest whole version; nothing is resolved again."""
        at = snapshots.version_at(spark, path)
        if at is None:
            raise FileNotFoundError(f"no snapshot at {path}; build it first")
        out = cls(*(spark.read.parquet(f"{at}/{name}") for name in TABLES))
        out._resolved, out._resolution = spark.read.parquet(f"{at}/resolved"), spark.read.parquet(f"{at}/resolution")
        return out


def unknown_id(surface) -> Column:
    """The lexeme of a surface that no form has: below zero, 62 bits of its hash.  Counts and matches go by id and lemma, so two words never become one."""
    return -2 - F.shiftrightunsigned(F.xxhash64(surface), 2)


def unknown_columns(surface: str = "surface") -> dict[str, Column]:
    """What an unknown surface is: its own form and lemma."""
    own, none = F.col(surface), F.array().cast("array<string>")
    return {
        "form": own, "f_idx": F.lit(0), "form_lexeme_id": unknown_id(own), "form_lemma": own, "form_pos": F.lit(UNKNOWN), "grammemes": none,
        "lexeme_id": unknown_id(own), "lemma": own, "pos": F.lit(UNKNOWN),
    }


def annotate(tokens: DataFrame, dictionary: Dictionary | None) -> DataFrame:
    """Adds form, f_idx, form_lexeme_id, form_lemma, form_pos, grammemes, lexeme_id, lemma, pos to a token table; an unknown surface is a lexeme of its own.

    One left join on the surface: Spark broadcasts the resolution by its size, or shuffles.
    """
    unknown = unknown_columns()
    if dictionary is None:
        return tokens.select("*", *(c.alias(name) for name, c in unknown.items()))
    return tokens.join(dictionary.resolution(), "surface", "left").select(*tokens.columns, *(F.coalesce(name, c).alias(name) for name, c in unknown.items()))


def annotated(corpus: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    return annotate(token_table(corpus), dictionary)


def is_function_word(pos):
    return pos.isin(*FUNCTION_POS)


def resolve_words(spark: SparkSession, words: list[str], dictionary: Dictionary | None) -> list[dict]:
    """A few words (a phrase, a query) looked up as tokens are."""
    rows = annotate(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "at long, surface string"), dictionary)
    return [r.asDict() for r in rows.orderBy("at").collect()]


def resolve_entries(entries: DataFrame, dictionary: Dictionary | None) -> DataFrame:
    """entry -> lexeme_id, lemma: words of patterns and thesauri.

    A word is looked up as a token is; one that is no form but a lemma stands
    for the first such lexeme, as resolved; any other is an unknown word.
    """
    found = annotate(entries.select(F.col("entry").alias("surface")).distinct(), dictionary).select("surface", "lexeme_id", "lemma", "pos")
    if dictionary is not None:
        lexemes = dictionary.lexemes.select("lexeme_id", F.col("lemma").alias("surface")).groupBy("surface").agg(F.min("lexeme_id").alias("lexeme_id"))
        named = lexemes.join(dictionary.resolved(), "lexeme_id").select("surface", F.col("resolved_id").alias("lexeme_id"))
        named = named.join(dictionary.lexemes.select("lexeme_id", "lemma"), "lexeme_id").select("surface", F.col("lexeme_id").alias("named_id"), F.col("lemma").alias("named"))
        found = found.join(named, "surface", "left")
        use = (F.col("pos") == UNKNOWN) & F.col("named_id").isNotNull()
        found = found.select("surface", F.when(use, F.col("named_id")).otherwise(F.col("lexeme_id")).alias("lexeme_id"), F.when(use, F.col("named")).otherwise(F.col("lemma")).alias("lemma"))
    return found.select(F.col("surface").alias("entry"), "lexeme_id", "lemma")


def surfaces_of(spark: SparkSession, lexemes: list[tuple[int, str]], dictionary: Dictionary | None) -> list[list[str]]:
    """For each of a few lexemes (id, lemma) the surfaces that resolve to it: a lexeme's forms, or an unknown word itself."""
    if dictionary is None:
        return [[lemma] for _, lemma in lexemes]
    known = sorted({i for i, _ in lexemes if i >= 0})
    found = dictionary.resolution().where(F.col("lexeme_id").isin(*known)).select("lexeme_id", "surface").collect() if known else []
    return [sorted(r.surface for r in found if r.lexeme_id == i) if i >= 0 else [lemma] for i, lemma in lexemes]
