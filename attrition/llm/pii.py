"""Personal data: base patterns and information-theoretic sanitisation.

Four patterns find protected entities (email, ip, card, phone). Over the whole
corpus it is then estimated how much a term tells about an entity of the same
document: with n(t), n(e) and n(t, e) the documents that hold the term, the
entity and both, the term gives away the share

    PMI(t; e) / IC(e) = 1 - log(n(t, e) / n(t)) / log(n(e) / N)

of the entity's information: 1 if it occurs nowhere else, 0 if it is independent.
Terms at or above ``DISCLOSURE`` which occur with the entity in at least
``SUPPORT`` different texts (so copies of one text prove nothing) become spans
of kind ``term`` in the documents that hold the entity. Characters of entities are
blanked before terms are read, so a name counts where it stands beside its own
e-mail, and not for being part of it. ``sanitise`` replaces
entities by their kind and removes such terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, read_table, sieved
from .quality_rules import let

DISCLOSURE = 0.9
SUPPORT = 3

KINDS = ["email", "ip", "card", "phone", "term"]

# The stated patterns. Possessive quantifiers and the look-behind
# leave the matches as they are; they keep long runs from taking square time or
# deep stacks.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without a match of this has no valid span of the kind.
QUICK = {
    "email": r"[A-Za-z0-9-]@[A-Za-z0-9-]|[._%+]@",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "phone": r"\+[0-9]",
}
TERM = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*+"
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _luhn(digits: Column) -> Column:
    def add(total, k):
        d = F.substr(digits, F.length(digits) - k, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(k % 2 == 1, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: let(
            F.regexp_replace(p, "^0+(?=[0-9])", ""),
            lambda z: (F.length(z) <= 3) & (F.substr(z, F.lit(1), F.lit(3)).cast("int") <= 255)))
    if kind == "card":
        return let(F.regexp_replace(match, r"[\x20-]", ""), lambda d: F.when(
            F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str, kind: int, valid) -> Column:
    """Spans of the leftmost non-overlapping matches: places follow from the
    lengths of the matches and of what lies between them."""
    def spans(found: Column) -> Column:
        def between(gaps: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

            def step(a, i):
                begin = a["at"] + F.length(F.get(gaps, i))
                end = begin + F.length(F.get(found, i))
                span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
                return F.struct(end.alias("at"), F.when(valid(F.get(found, i)), F.concat(
                    a["out"], F.array(span))).otherwise(a["out"]).alias("out"))
            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda a: a["out"])
        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), between)).otherwise(
            F.array().cast(SPAN))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end) of the four kinds, by start and kind; code
    points, end exclusive. Null counts as empty."""
    def of(t: Column) -> Column:
        parts = [F.when(t.rlike(QUICK[k]), _matches(t, PATTERNS[k], i, lambda m, k=k: _valid(k, m))
                        ).otherwise(F.array().cast(SPAN)) for i, k in enumerate(KINDS[:4])]
        return F.array_sort(F.concat(*parts))
    return let(F.coalesce(text.cast("string"), F.lit("")), of)


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _blanked(text: Column, spans: Column) -> Column:
    """The text with blanks for all characters of spans, at its own length."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, s):
        begin = F.greatest(s["start"], a["at"])
        return F.when(s["end"] <= a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(
            a["out"], F.substr(text, a["at"] + 1, begin - a["at"]),
            F.repeat(F.lit(" "), s["end"] - begin)).alias("out")))
    return F.aggregate(spans, start, step, lambda a: F.concat(
        a["out"], F.substr(text, a["at"] + 1, F.length(text))))


def _terms(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _entities(text: Column, spans: Column) -> Column:
    """The different entities of a text."""
    return F.array_distinct(F.transform(spans, lambda s: F.substr(text, s["start"] + 1, s["end"] - s["start"])))


def disclosing_terms(found: DataFrame, n_docs: int, docs: DataFrame, text_col: str = "text",
                     disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(_row, term) of the terms that give an entity of that row away."""
    texts = found.where("size(_spans) > 0").select("_row", "_text", "_spans")
    mentions = checkpointed(texts.select("_row", F.xxhash64("_text").alias("copy"), F.explode(
        _entities(F.col("_text"), F.col("_spans"))).alias("entity")))
    # No pair of an entity with fewer texts has enough of them
    entities = mentions.groupBy("entity", "copy").agg(F.count(F.lit(1)).alias("n")).groupBy("entity").agg(
        F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("texts")).where(
        (F.col("texts") >= support) & (F.col("n_e") < n_docs)).drop("texts")
    holders = checkpointed(mentions.join(entities, "entity").groupBy("_row", "copy").agg(
        F.collect_list(F.struct("entity", "n_e")).alias("entities")))  # those of one document
    first = holders.groupBy("copy").agg(F.min("_row").alias("_row")).select("_row", F.lit(1).alias("first"))
    some = sieved(texts, "_row", holders, "_row").where("__maybe").drop("__maybe")
    beside = some.join(holders.join(first, "_row", "left"), "_row").select(
        "_row", "first", "entities", _terms(_blanked(F.col("_text"), F.col("_spans"))).alias("terms")).select(
        "_row", "first", "terms", F.explode("entities").alias("e")).select(
        "_row", "first", "e.entity", "e.n_e", F.explode("terms").alias("term"))
    pairs = checkpointed(beside.groupBy("entity", "n_e", "term").agg(
        F.count(F.lit(1)).alias("n_te"), F.count("first").alias("texts")).where(F.col("texts") >= support))
    # A term that a document holds inside entities alone doesn't count there
    one, less = F.lit(1).alias("n"), F.lit(-1).alias("n")
    rows = docs.select(F.explode(_terms(F.col(text_col).cast("string"))).alias("term"), one).unionByName(
        texts.select(F.explode(_terms(F.col("_text"))).alias("term"), less)).unionByName(
        texts.select(F.explode(_terms(_blanked(F.col("_text"), F.col("_spans")))).alias("term"), one))
    counts = sieved(rows, "term", pairs, "term").where("__maybe").groupBy("term").agg(F.sum("n").alias("n_t"))
    told = pairs.join(counts, "term").where(
        1 - F.log(F.col("n_te") / F.col("n_t")) / F.log(F.col("n_e") / F.lit(n_docs)) >= disclosure)
    return beside.join(told.select("entity", "term"), ["entity", "term"], "left_semi").select(
        "_row", "term").distinct()


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans (arrays of start, kind,
    end), and the text where it has spans, else null.

    Null texts count as empty and have no spans; spans of different kinds may
    overlap; rows that repeat an id are kept apart. Terms are runs of letters and
    digits of any length, compared in lower case. Other columns are ignored; an empty
    table gives no rows. Runs a job when called: spans, and the texts that have
    some, are written to the shared folder.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_t"))
    rows = rows.withColumn("_spans", base_spans(F.col("_t")))
    found = checkpointed(rows.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", "_spans",
        F.when(F.size("_spans") > 0, F.col("_t")).alias("_text")))
    terms = disclosing_terms(found, found.count(), docs, text_col, disclosure, support).groupBy("_row").agg(
        F.collect_set("term").alias("_terms"))  # at most the different words of one document
    more = F.when(F.col("_terms").isNotNull(), let(_blanked(F.col("_text"), F.col("_spans")), lambda t: _matches(
        t, TERM, 4, lambda m: F.array_contains(F.col("_terms"), F.lower(m))))).otherwise(F.array().cast(SPAN))
    out = found.join(terms, "_row", "left")
    return out.select("doc_id", F.col("_spans").alias("base"),
                      F.array_sort(F.concat("_spans", more)).alias("spans"), F.col("_text").alias("text"))


def sanitise(text: Column, spans: Column) -> Column:
    """The text with entities generalised to their kind and terms removed; of
    overlapping spans the first stands for all."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS[:4]], F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, s):
        return F.when(s["start"] < a["at"], F.struct(
            F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(
                s["end"].alias("at"), F.concat(a["out"], F.substr(
                    text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"])).alias("out")))
    return F.aggregate(spans, start, step, lambda a: F.concat(
        a["out"], F.substr(text, a["at"] + 1, F.length(text))))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read_table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        # one argument: Spark gives a second one the place in the array
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"))
