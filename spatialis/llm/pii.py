"""Personal data, and information-theoretic sanitisation of what gives it away; DataFrame functions only.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers, found by pattern and
checked. Each distinct value is a protected entity. Over all rows, a term (a word of LETTERS letters or
more, lower-cased) discloses an entity by the share of the entity's information that it gives:

    disclosure(t, e) = PMI(t; e) / IC(e) = ln(n(e,t) * N / (n(e) * n(t))) / ln(N / n(e))

with n the number of rows that hold one or both. In the rows that hold e, terms of disclosure GENERALISE
or more are replaced by a general tag, of REMOVE or more removed, once two different texts hold both (one
text alone is no estimate). Rows without an entity are left as they are.

Null texts count as empty and stay null when sanitised; copies and repeated rows have the same spans;
texts are searched whole; columns that clash with output columns are replaced; an empty table gives an
empty one. Positions are code points, ends exclusive. Added spans never overlap base ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatialis.llm.common import free_name, staged

#: Possessive repeats take what the plain ones would and don't backtrack; a run of characters is entered
#: at its beginning or where the last match ended, which is where a leftmost match begins.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
LETTERS, GENERALISE, REMOVE = 4, 0.75, 0.9
#: Terms of texts with shared entities up to which they are broadcast to the count over all texts.
BROADCAST_TERMS = 200_000
KINDS = ("email", "ip", "card", "phone", "term")
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalised": "[TERM]", "removed": ""}
_SPANS = "array<struct<start:int,end:int,value:string>>"


#: Items of a list that are gone through at a time: a list that grows by one item is copied at each step.
STRIDE = 128


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _strides(items: Column) -> Column:
    """A list in parts of STRIDE items, one at least."""
    last = F.greatest(F.lit(0), F.floor((F.size(items) - 1) / STRIDE)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * STRIDE + 1, F.lit(STRIDE)))


def _scanned(items: Column, zero: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """The items that `step` (state, item) -> (state, made, whether it is kept) makes of a list in its order; `out`
    is the type of their list. Parts are gone through one after another and then joined, so the time for a list
    grows little faster than the list."""

    def own(acc: Column, item: Column) -> Column:
        state, made, kept = step(acc["state"], item)
        return F.struct(state.alias("state"), F.when(kept, F.concat(acc["out"], F.array(made).cast(out))).otherwise(acc["out"]).alias("out"))

    def part(acc: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(acc["state"].alias("state"), F.array().cast(out).alias("out")), own)
        return _bound(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["outs"], F.array(d["out"])).alias("outs")))

    start = F.struct(zero.alias("state"), F.array().cast(f"array<{out}>").alias("outs"))
    return _bound(items, lambda x: F.aggregate(_strides(x), start, part, lambda acc: F.flatten(acc["outs"])))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int") * (F.lit(1) + (i + 1) % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _is_card(x: Column) -> Column:
    d = _digits(x)
    return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)


def find_all(text: Column, pattern: str | Column, fits: Callable[[Column], Column] | None = None) -> Column:
    """Spans (start, end, value) of the pattern's matches that fit, in order: the texts between matches
    give the places of the matches."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))

    def step(at: Column, p: Column) -> tuple[Column, Column, Column]:
        a = at + F.length(F.coalesce(p["gap"], F.lit("")))
        b = a + F.length(F.coalesce(p["hit"], F.lit("")))
        good = p["hit"].isNotNull() & (fits(p["hit"]) if fits else F.lit(True))
        return b, F.struct(a.alias("start"), b.alias("end"), p["hit"].alias("value")), good

    return _scanned(pieces, F.lit(0), _SPANS, step)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind; a cheap test goes before each search."""
    none = F.array().cast(_SPANS)
    text = F.coalesce(text, F.lit(""))
    n_digits = lambda x: F.length(_digits(x))
    return {
        "email": F.when(F.contains(text, F.lit("@")), find_all(text, EMAIL)).otherwise(none),
        "ip": F.when(F.rlike(text, F.lit(r"[0-9]\.[0-9]")), find_all(text, IP, lambda x: F.rlike(x, F.lit(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")))).otherwise(none),
        "card": F.when(F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){15}")), find_all(text, CARD, _is_card)).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), find_all(text, PHONE, lambda x: n_digits(x).between(8, 15))).otherwise(none),
    }


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{{LETTERS},}}"), F.lit(0)))


def detected(docs: DataFrame, text: str = "text", key: tuple[str, str] = ("pii_a", "pii_b")) -> DataFrame:
    """`docs` with a column of spans for each base kind and the key of the text, in two columns."""
    t = F.col(text)
    return docs.withColumns({**base_spans(t), key[0]: F.xxhash64(F.lit(11), t), key[1]: F.xxhash64(t, F.lit(29), F.length(t))})


def disclosing_terms(found: DataFrame, text: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(pii_a, pii_b, term): the spans of disclosing terms of each text that has any, with `removed`."""
    value = lambda k: F.transform(F.col(k), lambda s: F.concat(F.lit(f"{k}:"), F.lower(s["value"]) if k in ("email", "ip") else _digits(s["value"])))
    entities = F.array_distinct(F.concat(*[value(k) for k in KINDS[:4]]))
    some = found.where(" + ".join(f"size({k})" for k in KINDS[:4]) + " > 0")
    # The texts that hold entities, once each.
    dirty = staged(
        some.groupBy("pii_a", "pii_b").agg(F.first(text).alias("text"), F.first(entities).alias("entities"), F.count(F.lit(1)).alias("copies")),
        "dirty",
    )
    held = dirty.select("pii_a", "pii_b", "copies", F.explode("entities").alias("entity"))
    shared = staged(held.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count(F.lit(1)).alias("texts")).where("texts > 1").drop("texts"), "entities")
    # Terms of the texts with entities that several texts hold.
    pairs = staged(
        dirty.select("pii_a", "pii_b", "copies", "text", F.explode("entities").alias("entity"))
        .join(shared.select("entity"), "entity", "left_semi")
        .select("entity", "pii_a", "pii_b", "copies", F.explode(_terms(F.col("text"))).alias("t")),
        "pairs",
    )
    both = staged(pairs.groupBy("entity", "t").agg(F.sum("copies").alias("n_et"), F.count(F.lit(1)).alias("texts")).where("texts > 1").drop("texts"), "both")
    wanted = staged(both.select("t").distinct(), "wanted")
    every = found.select(F.explode(_terms(F.coalesce(F.col(text), F.lit("")))).alias("t"))
    count = lambda df: df.groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
    if wanted.count() <= BROADCAST_TERMS:  # few terms: no other is counted
        counts = count(every.join(F.broadcast(wanted), "t", "left_semi"))
    else:
        counts = count(every).join(wanted, "t", "left_semi")
    counts = staged(counts, "terms")
    n = float(found.count())
    ic = F.log(F.lit(n) / F.col("n_e"))
    pmi = F.log(F.col("n_et") * F.lit(n) / (F.col("n_e").cast("double") * F.col("n_t")))
    # Rounded, so that the order of the logarithms' last digits settles nothing.
    share = F.when(ic > 0, F.round(pmi / ic, 9)).otherwise(0.0)
    telling = staged(both.join(counts, "t").join(shared, "entity").withColumn("share", share).where(F.col("share") >= generalise).select("entity", "t", "share"), "telling")
    own = (
        pairs.join(telling, ["entity", "t"])
        .groupBy("pii_a", "pii_b", "t")
        .agg(F.max("share").alias("share"))
        .groupBy("pii_a", "pii_b")
        .agg(F.collect_list("t").alias("ts"), F.collect_list(F.when(F.col("share") >= remove, F.col("t"))).alias("gone"))
    )
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.array_sort("ts"), "|"), F.lit(r")(?!\p{L})"))
    spans = dirty.select("pii_a", "pii_b", "text").join(own, ["pii_a", "pii_b"])
    removed = lambda s: F.struct(s["start"], s["end"], s["value"], F.array_contains("gone", F.lower(s["value"])).alias("removed"))
    return staged(spans.select("pii_a", "pii_b", F.transform(find_all(F.col("text"), pattern), removed).alias("term")), "term_spans")


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the spans of each kind of KINDS; those of terms lie apart from the base ones."""
    docs = docs.drop(*KINDS)
    a, b = key = free_name(docs, "pii_a"), free_name(docs, "pii_b")
    found = detected(docs, text, key)
    own = found.select(F.col(text).alias("text"), *KINDS[:4], F.col(a).alias("pii_a"), F.col(b).alias("pii_b"))
    terms = disclosing_terms(own).withColumnsRenamed({"pii_a": a, "pii_b": b})
    base = F.concat(*[F.col(k) for k in KINDS[:4]])
    has = F.size(base) > 0
    # A term meets a base span if, of those that begin before its end, one ends after its start: in the order of
    # these places, the greatest end so far tells.
    place = lambda pos, order, x, value, removed: F.struct(pos.alias("pos"), F.lit(order).alias("order"), x["start"].alias("start"), x["end"].alias("end"), value.alias("value"), removed.alias("removed"))
    begun = F.transform(base, lambda x: place(x["start"], 1, x, F.lit(None).cast("string"), F.lit(None).cast("boolean")))
    ended = F.transform("term", lambda x: place(x["end"], 0, x, x["value"], x["removed"]))

    def meet(end: Column, x: Column) -> tuple[Column, Column, Column]:
        term = x["order"] == 0
        return F.when(term, end).otherwise(F.greatest(end, x["end"])), F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["removed"].alias("removed")), term & (end <= x["start"])

    apart = _scanned(F.array_sort(F.concat(begun, ended)), F.lit(0), "array<struct<start:int,end:int,value:string,removed:boolean>>", meet)
    none = F.array().cast("array<struct<start:int,end:int,value:string,removed:boolean>>")
    return found.join(terms, [a, b], "left").withColumn("term", F.when(has & F.col("term").isNotNull(), apart).otherwise(none)).drop(a, b)


def span_string(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans of the kinds, in their order."""
    one = lambda k: F.transform(F.col(k), lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(F.concat(*[one(k) for k in kinds]), ",")


def sanitised(spanned: DataFrame, text: str = "text") -> DataFrame:
    """What with_spans gives, with `text` replaced: each span by its tag; spans that run into one another
    are replaced by the first one's tag."""
    tag = lambda k: F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (F.lit(TAGS[k]) if k != "term" else F.when(s["removed"], TAGS["removed"]).otherwise(TAGS["generalised"])).alias("tag")))
    every = F.array_sort(F.concat(*[tag(k) for k in KINDS]))
    t = F.col(text)

    def step(at: Column, s: Column) -> tuple[Column, Column, Column]:
        piece = F.struct(at.alias("from"), s["start"].alias("to"), s["tag"].alias("tag"))
        return F.greatest(at, s["end"]), piece, s["start"] >= at

    def cut(some: Column) -> Column:
        """The gaps and tags of a part: its stretch of the text is taken once, and gaps from there."""
        first = F.get(some, F.lit(0))["from"]
        stretch = F.substr(t, first + 1, F.get(some, F.size(some) - 1)["to"] - first)
        return _bound(stretch, lambda own: F.array_join(F.transform(some, lambda p: F.concat(F.substr(own, p["from"] - first + 1, p["to"] - p["from"]), p["tag"])), ""))

    pieces = _scanned(every, F.lit(0), "array<struct<from:int,to:int,tag:string>>", step)
    last = F.array_max(F.transform(every, lambda s: s["end"]))
    whole = F.concat(_bound(pieces, lambda x: F.array_join(F.transform(_strides(x), cut), "")), F.substr(t, last + 1))
    return spanned.withColumn(text, F.when(F.size(every) > 0, whole).otherwise(t))
