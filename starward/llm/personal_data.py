"""Personal data in texts, and the terms around it that give it away. DataFrame functions only.

Base spans are found by four patterns and checks of their digits. Then the corpus decides which
other terms disclose a protected value e (an address, a number, as found): for a term t in the
context of e, with N documents, n(e) of them with e, n(t) with t and n(t, e) with t near e,

    disclosure(t, e) = log(n(t, e) * N / (n(t) * n(e))) / log(N / n(e))

is pointwise mutual information as a share of the information content of e: 1 if t never occurs
without e. From ``general`` on a term is generalised, from ``remove`` on it is removed, at every
mention of e that has it in its context. Only pairs seen in ``support`` different contexts count,
so that copies of one document prove nothing. All counts run over all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starward.sources.shared import write_shared

# The kinds in their order, and the patterns of the base spans. They match what the
# plain patterns match; possessive repeats and the conditions on where a match may start spare
# the search from starting again inside a run. A card has 12 to 19 digits, so its pattern says so.
KINDS = ["email", "ip", "card", "phone", "term", "removed"]
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A term: three letters or more between white space or punctuation of the sentence.
TERM = r"""(?<![^\s("'])\p{L}{3,}+(?=[\s,;:!?)"']|\.(?:\s|$)|$)"""
#: Characters of context on either side of a mention; one more shows where a word is cut.
REACH = 80

SPAN = "array<struct<start: int, kind: int, end: int, value: string, before: string, after: string>>"


def located(text: Column, pattern: str, kind: int) -> Column:
    """Every match with its place in code points and the text around it, left to right."""
    both = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
    )

    def walk(state: Column, at: Column) -> Column:
        start = state["upto"] + F.length(at["gaps"])
        end = start + F.length(at["found"])
        span = F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), at["found"].alias("value"),
            F.right(at["gaps"], F.lit(REACH + 1)).alias("before"),
            F.left(at["next"], F.lit(REACH + 1)).alias("after"),
        )
        return F.struct(end.alias("upto"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def spans(one: Column) -> Column:
        n = F.size(one["found"])
        rows = F.arrays_zip(
            F.slice(one["gaps"], F.lit(1), n).alias("gaps"), one["found"].alias("found"),
            F.slice(one["gaps"], F.lit(2), n).alias("next"),
        )
        none = F.struct(F.lit(0).alias("upto"), F.array().cast(SPAN).alias("spans"))
        return F.aggregate(rows, none, walk, lambda state: state["spans"])

    return F.element_at(F.transform(F.array(both), spans), 1)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def small_parts(value: Column) -> Column:
    """Every part of an address is at most 255."""
    bare = F.transform(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+", ""))
    return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def luhn(value: Column) -> Column:
    reverse = F.reverse(digits(value))

    def add(total: Column, at: Column) -> Column:
        digit = F.ascii(F.substring(reverse, at, F.lit(1))) - 48
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(at % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(reverse)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """The spans of the four kinds by start, then kind. Texts that cannot hold a kind are skipped."""
    none = F.array().cast(SPAN)

    def searched(kind: int, hint: Column, pattern: str, fits) -> Column:
        kept = F.filter(located(text, pattern, kind), lambda s: fits(s["value"]))
        return F.when(hint, kept).otherwise(none)

    every = F.concat(
        searched(0, F.contains(text, F.lit("@")), EMAIL, lambda v: F.lit(True)),
        searched(1, text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), IP, small_parts),
        searched(2, text.rlike("[0-9](?:[ -]?[0-9]){11}"), CARD, luhn),
        searched(3, text.rlike(r"\+[0-9]"), PHONE, lambda v: F.length(digits(v)).between(9, 15)),
    )
    return F.array_sort(every)


def _context(spans: DataFrame) -> DataFrame:
    """The terms around every mention: whole words within reach, with their place in the text."""
    mention = spans.select(
        "key",
        "text_key",
        F.explode("spans").alias("s"),
    ).select(
        "key", "text_key", F.concat_ws(":", "s.kind", "s.value").alias("entity"), "s",
        F.xxhash64("s.before", "s.after").alias("context"),
    )
    before, after = F.col("s.before"), F.col("s.after")
    left = F.filter(located(before, TERM, 4), lambda t: (F.length(before) <= REACH) | (t["start"] > 0))
    right = F.filter(located(after, TERM, 4), lambda t: (F.length(after) <= REACH) | (t["end"] <= REACH))

    def moved(terms: Column, by: Column) -> Column:
        return F.transform(
            terms,
            lambda t: F.struct(
                (t["start"] + by).alias("start"), (t["end"] + by).alias("end"), F.lower(t["value"]).alias("term")
            ),
        )

    terms = F.concat(moved(left, F.col("s.start") - F.length(before)), moved(right, F.col("s.end")))
    return mention.select("key", "text_key", "entity", "context", F.inline(terms))


def _disclosing(
    documents: DataFrame, context: DataFrame, support: int, general: float, remove: float
) -> DataFrame:
    """(entity, term, kind) of the terms that disclose an entity."""
    pairs = (
        context.groupBy("entity", "term")
        .agg(
            F.countDistinct("context").alias("contexts"),
            F.countDistinct("key", "text_key").alias("n_both"),
        )
        .where(F.col("contexts") >= support)
    )
    entities = context.groupBy("entity").agg(F.countDistinct("key", "text_key").alias("n_entity"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    terms = documents.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("term").alias("n_term"))
    total = F.lit(documents.count())
    counted = pairs.join(entities, "entity").join(terms, "term").withColumn("n", total)
    information = F.log(F.col("n") / F.col("n_entity"))
    shared = F.log(F.col("n_both") * F.col("n") / (F.col("n_term") * F.col("n_entity")))
    share = F.when(information > 0, shared / information).otherwise(0.0)
    return counted.select(
        "entity",
        "term",
        F.when(share >= remove, 5).when(share >= general, 4).alias("kind"),
    ).where("kind IS NOT NULL")


def personal_data(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    support: int = 3,
    general: float = 0.7,
    remove: float = 0.9,
) -> DataFrame:
    """One row per row of ``documents``: key, text_key, base, spans.

    ``base`` and ``spans`` are arrays of (start, kind, end), kind as a place in ``KINDS``, in code
    points, end exclusive, by start and then kind; ``spans`` has the disclosing terms as well
    (kind 4: to be generalised, 5: to be removed). ``text_key`` is a hash of the text: equal rows
    have equal spans, rows that share a key with another text do not mix. Null and empty texts
    have no spans, a null key is a key. Other columns are not read, whatever their names. An
    empty table gives an empty result.
    """
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = write_shared(
        rows.select("key", F.xxhash64("text").alias("text_key"), base_spans(F.col("text")).alias("spans")),
        "base-spans",
    )
    context = write_shared(_context(found.where(F.size("spans") > 0)), "contexts")
    disclosing = _disclosing(rows, context, support, general, remove)
    added = (
        context.join(disclosing, ["entity", "term"])
        .groupBy("key", "text_key")
        .agg(F.collect_set(F.struct("start", F.col("kind"), "end")).alias("terms"))
        .toDF("k", "t", "terms")
    )
    plain = F.transform("spans", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    joined = found.join(added, F.col("key").eqNullSafe(F.col("k")) & (F.col("text_key") == F.col("t")), "left")
    return joined.select(
        F.col("key").alias(key),
        "text_key",
        plain.alias("base"),
        F.when(F.col("terms").isNull(), plain).otherwise(F.array_sort(F.concat(plain, "terms"))).alias("spans"),
    )


def span_list(spans: Column) -> Column:
    """kind:start:end, joined by commas; terms of either fate are ``term``."""
    names = F.array(*[F.lit(kind) for kind in [*KINDS[:5], KINDS[4]]])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
        ),
        ",",
    )


def sanitised(documents: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with the spans of ``found`` (their own rows) replaced in ``text``.

    A base span becomes its kind in brackets, a generalised term ``[term]``; a removed one goes.
    Where spans overlap, the first one stands for both. Texts without spans stay as they are, null
    texts stay null; the other columns are kept.
    """
    whole = documents[text]
    spans = found.where(F.size("spans") > 0).select(
        F.col(key).alias("own_key"), F.col("text_key").alias("own_text"), F.col("spans").alias("own_spans")
    ).dropDuplicates(["own_key", "own_text"])
    marks = F.array(*[F.lit(f"[{kind}]") for kind in KINDS[:5]], F.lit(""))

    def splice(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["upto"]
        gap = F.substring(whole, state["upto"] + 1, span["start"] - state["upto"])
        part = F.concat(gap, F.element_at(marks, span["kind"] + 1))
        return F.struct(
            F.greatest(state["upto"], span["end"]).alias("upto"),
            F.when(fresh, F.concat(state["parts"], F.array(part))).otherwise(state["parts"]).alias("parts"),
        )

    start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("parts"))
    made = F.aggregate(
        spans["own_spans"],
        start,
        splice,
        lambda state: F.concat(
            F.array_join(state["parts"], ""), F.substring(whole, state["upto"] + 1, F.length(whole))
        ),
    )
    replaced = F.when(spans["own_spans"].isNull(), whole).otherwise(made).alias(text)
    hashed = F.xxhash64(F.coalesce(whole, F.lit("")))
    same = documents[key].eqNullSafe(spans["own_key"]) & (hashed == spans["own_text"])
    return documents.join(spans, same, "left").select(
        *[replaced if name == text else documents[name] for name in documents.columns]
    )
