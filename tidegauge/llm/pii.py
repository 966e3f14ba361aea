"""Personal data: patterns for direct identifiers, corpus statistics for the terms that give them away.

Native: column functions and joins only. Positions are code points, ends exclusive.

A term near a protected value (an email, address, card or phone number) tells
something about it. With ``n_ct`` mentions of the term near the value, ``n_c``
mentions of all terms near the value, ``n_t`` mentions of the term anywhere and
``m`` mentions of all terms, the pointwise mutual information over the
information content of the value,

    log(n_ct * m / (n_c * n_t)) / log(m / n_c),

is 1 when the term occurs only beside the value and 0 when it is independent
of it. Terms at or above a threshold are generalised or removed.

Few mentions count if chance does not explain them. Copies are no evidence, so
``k`` counts different surroundings of the pair, ``n_d`` the different terms of
each surrounding of the value, and the term's mentions shrink by its own share
of copies, ``k / n_ct``. Were the term independent of the value, it would stand
beside it ``e = n_t * k / n_ct * n_d / m`` times; the chance of ``k`` times is
then at most ``exp(k - e - k * log(k / e))``.
That chance times the number of pairs a corpus could show (distinct terms times
distinct values) must not exceed ``chance``. So a value needs no fixed number
of mentions: the rarer the term and the larger the corpus, the fewer suffice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.common import free_names, let, whole_text, write_once

KINDS = ("email", "ip", "card", "phone", "term")

# A run that is scanned once cannot match from a later start either, so each pattern
# starts at the left end of its run and never gives characters back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# A maximal run of letters, digits and marks, with single joiners inside.
TERM = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*+(?:['’‐‑-][\p{L}\p{N}][\p{L}\p{M}\p{N}]*+)*+"
_BLOCK = 64


def running(values: Column, combine, unit: int) -> Column:
    """Running totals of an array in two levels, so that long arrays stay cheap.

    ``out[i]`` combines ``values[0..i]``. Work is (64 + n / 64 ** 2) per element.
    """
    def fold(part: Column) -> Column:
        return F.aggregate(part, F.lit(unit), combine)

    def within(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")),
                             lambda b: F.slice(v, b * _BLOCK + 1, _BLOCK))
        return let(blocks, lambda bs: let(F.transform(bs, fold), lambda sums: F.flatten(F.transform(
            bs, lambda block, b: let(fold(F.slice(sums, F.lit(1), b)), lambda before: F.transform(
                block, lambda _, i: combine(before, fold(F.slice(block, F.lit(1), i + 1)))))))))

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(within(v)))


def find_all(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<start, end, value>>``.

    The matches and the pieces between them come from the same regular
    expression; running lengths give the places.
    """
    def placed(found: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda gaps: let(
            running(F.transform(found, lambda m, i: F.length(gaps[i]) + F.length(m)), lambda a, x: a + x, 0),
            lambda ends: F.transform(found, lambda m, i: F.struct(
                (ends[i] - F.length(m)).alias("start"), ends[i].alias("end"), m.alias("value")))))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)))


def _luhn(digits: Column) -> Column:
    """Sum of digits, every second from the right doubled, is a multiple of ten."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.rlike(value, F.lit(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"))
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds by start, then kind: ``array<struct<start, rank, end, value>>``."""
    def of(kind: str) -> Column:
        found = find_all(text, PATTERNS[kind])
        sign = {"email": "@", "phone": "+", "ip": "."}.get(kind)
        if sign:
            none = F.array().cast("array<struct<start:int,end:int,value:string>>")
            found = F.when(F.contains(text, F.lit(sign)), found).otherwise(none)
        held = F.filter(found, lambda x: _holds(kind, x["value"]))
        return F.transform(held, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
                                                    x["end"].alias("end"), x["value"].alias("value")))

    return F.sort_array(F.concat(*[of(kind) for kind in PATTERNS]))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _unmarked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of the spans, so that all places stay; terms are sought outside the spans."""
    return F.when(F.size(spans) == 0, text).otherwise(let(
        F.struct(spans.alias("s"), running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b), 0)
                 .alias("ends")), lambda p: F.concat(F.array_join(F.transform(p["s"], lambda x, i: let(
                     F.when(i == 0, 0).otherwise(F.get(p["ends"], i - 1)), lambda done: F.concat(
                         F.substring(text, done + 1, F.greatest(x["start"] - done, F.lit(0))),
                         F.repeat(F.lit(" "), F.greatest(x["end"] - F.greatest(x["start"], done), F.lit(0)))))), ""),
                     F.substring(text, F.element_at(p["ends"], -1) + 1, F.length(text)))))


def _terms(plain: Column) -> Column:
    """All mentions of terms in a text without its spans, in lower case."""
    return F.transform(F.regexp_extract_all(plain, F.lit(TERM), F.lit(0)), F.lower)


def _term_spans(plain: Column, terms: Column) -> Column:
    """Spans of every mention of the given lower-case terms."""
    found = F.filter(find_all(plain, TERM), lambda t: F.array_contains(terms, F.lower(t["value"])))
    return F.transform(found, lambda t: F.struct(
        t["start"].alias("start"), F.lit(KINDS.index("term")).alias("rank"), t["end"].alias("end")))


def _near(text: Column, plain: Column, spans: Column, reach: int) -> Column:
    """Terms that lie within ``reach`` characters of each span, with the value they stand by.

    ``plain`` is the text without its spans. Each side is cut with one more
    character at both ends, which tells whole terms from parts.
    """
    def of(begin: Column, end: Column, entity: Column, context: Column) -> Column:
        first = F.greatest(begin - 1, F.lit(0))
        part = F.substring(plain, first + 1, end + 1 - first)
        return F.transform(F.filter(find_all(part, TERM), lambda t: (first + t["start"] >= begin) & (first + t["end"] <= end)),
                           lambda t: F.struct(entity.alias("entity"), F.lower(t["value"]).alias("term"), context.alias("context"),
                                              (first + t["start"]).alias("start"), (first + t["end"]).alias("end")))

    def around(s: Column) -> Column:
        begin = F.greatest(s["start"] - reach, F.lit(0))
        left = F.substring(text, begin + 1, s["start"] - begin)
        right = F.substring(text, s["end"] + 1, F.lit(reach))
        entity = F.concat(s["rank"].cast("string"), F.lit(":"), F.lower(s["value"]))
        return let(F.xxhash64(left, right), lambda context: F.concat(
            of(begin, s["start"], entity, context), of(s["end"], s["end"] + reach, entity, context)))

    return F.flatten(F.transform(spans, around))


def disclosing_terms(docs: DataFrame, mentions: DataFrame, plain: str, threshold: float = 0.9,
                     min_contexts: int = 2, chance: float = 0.05) -> DataFrame:
    """Pairs (entity, term) whose term discloses the entity.

    Counts cover all documents; ``plain`` holds their texts without spans. Evidence is the number of different
    surroundings, so copies of one text do not make a pattern, and must be beyond ``chance``, the number of
    such pairs expected in the whole corpus if terms and values were independent. Pairs under ``min_contexts``
    surroundings are left out before the counts are joined; one surrounding alone is never beyond chance.
    """
    seen = mentions.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
    pairs = (seen.groupBy("entity", "term").agg(F.sum("n").alias("n_ct"), F.count(F.lit(1)).alias("contexts"))
             .where(F.col("contexts") >= min_contexts))
    entities = write_once(seen.groupBy("entity").agg(F.sum("n").alias("n_c"), F.count(F.lit(1)).alias("n_d")), "entities")
    terms = docs.select(F.explode(_terms(F.col(plain))).alias("term"))
    counts = write_once(terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), "term-counts")
    joined = pairs.join(entities, "entity").join(counts, "term").withColumns({
        "m": counts.agg(F.sum("n_t")).scalar(),
        "tests": F.log(counts.agg(F.count(F.lit(1))).scalar()) + F.log(entities.agg(F.count(F.lit(1))).scalar())})
    both = F.least("n_ct", "n_t")
    told = F.log(both * F.col("m") / (F.col("n_c") * F.col("n_t")))
    share = F.when(F.col("m") > F.col("n_c"), told / F.log(F.col("m") / F.col("n_c"))).otherwise(0.0)
    k = F.col("contexts")
    e = F.col("n_t") * k / both * F.col("n_d") / F.col("m")
    beyond = (k > e) & (k - e - k * F.log(k / e) + F.col("tests") <= math.log(chance))
    return joined.withColumn("disclosure", share).where((F.col("disclosure") >= threshold) & beyond).select(
        "entity", "term", "disclosure")


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.9, min_contexts: int = 2,
             reach: int = 48, remove: bool = False, chance: float = 0.05) -> DataFrame:
    """Find personal data and disclosing terms and mask them.

    Added: ``base`` and ``spans`` (arrays of start, rank in ``KINDS``, end, by
    start then kind) and ``sanitised_text`` with ``[EMAIL]``, ``[IP]``,
    ``[CARD]``, ``[PHONE]`` and ``[TERM]`` (or nothing, with ``remove``) in
    place of the spans. Columns of these names are replaced.

    A null text counts as empty and gives no spans and an empty sanitised text.
    A term that discloses a value is masked wherever it stands, near the value
    or not, in every text.

    Rows are told apart by key and text, a null key included, so repeated rows
    get the same spans. Empty tables give empty ones. The mentions near
    protected values, the counts of all terms, the disclosing terms and the terms of each text are
    written to the shared folder, so the planner knows their size before it
    joins them.
    """
    row, mark, plain, same_key, same_row, held_terms = free_names(
        docs, "text_mark", "found", "plain_text", "__key", "__row", "__terms")
    body = whole_text(text)
    based = docs.withColumns({mark: base_spans(body), row: F.xxhash64(body)}).withColumn(plain, _unmarked(body, F.col(mark)))
    mentions = write_once(
        based.where(F.size(mark) > 0)
        .select(F.col(key).alias("key"), F.col(row).alias("row"), F.explode(_near(body, F.col(plain), F.col(mark), reach)).alias("x"))
        .select("key", "row", "x.*"), "mentions")
    telling = write_once(disclosing_terms(based, mentions, plain, threshold, min_contexts, chance).select("term").distinct(), "telling")
    held = based.select(F.col(key).alias(same_key), F.col(row).alias(same_row),
                        F.explode(F.array_distinct(_terms(F.col(plain)))).alias("term"))
    terms = write_once(held.join(telling, "term", "left_semi").groupBy(same_key, same_row)
                       .agg(F.collect_set("term").alias(held_terms)), "terms")
    base = F.transform(mark, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"),
                                                 s["end"].alias("end")))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return (based.join(terms, (F.col(row) == F.col(same_row)) & F.col(key).eqNullSafe(F.col(same_key)), "left")
            .withColumn("base", base)
            .withColumn("spans", F.sort_array(F.concat(
                "base", F.when(F.col(held_terms).isNull(), empty).otherwise(_term_spans(F.col(plain), F.col(held_terms))))))
            .withColumn("sanitised_text", masked(body, F.col("spans"), remove))
            .drop(mark, row, plain, same_key, same_row, held_terms))


def masked(text: Column, spans: Column, remove: bool = False) -> Column:
    """The text with a mask for each span; what overlaps an earlier span adds no second mask."""
    names = F.array(*[F.lit("" if remove and kind == "term" else f"[{kind.upper()}]") for kind in KINDS])

    def cut(parts: Column) -> Column:
        s, ends = parts["s"], parts["ends"]
        pieces = F.transform(s, lambda x, i: let(
            F.when(i == 0, 0).otherwise(F.get(ends, i - 1)), lambda done: F.when(x["start"] < done, "").otherwise(
                F.concat(F.substring(text, done + 1, x["start"] - done), names[x["rank"]]))))
        last = F.element_at(ends, -1)
        return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))

    ends = running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b), 0)
    return F.when(F.size(spans) == 0, text).otherwise(
        let(F.struct(spans.alias("s"), ends.alias("ends")), cut))
