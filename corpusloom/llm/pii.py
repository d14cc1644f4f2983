"""Personal data: base patterns, and terms that reveal a protected entity by corpus co-occurrence.

Everything is DataFrame functions. Base spans come from four patterns, written with possessive
quantifiers and look-behinds that leave their leftmost matches as they are but keep the time linear.

A base value is a protected entity e. A term t is a word that stands in a document with it, however far
away. Over all documents, with p as shares of documents, t discloses

    d(e, t) = PMI(e, t) / IC(e) = log(p(e, t) / (p(e) p(t))) / -log p(e)

of e: 1 if t occurs only beside e, 0 if they are independent. p(t) counts UNSEEN documents more than hold
t, as if it stood there without e: what few documents say weighs less, and entities that occur once have
an estimate too. In a document of an entity, a term of at least GENERALISE is replaced by its shape and one
of at least REMOVE is removed. Equal texts with personal data count as one document everywhere, so a
word that stands beside an address only because a document was copied reveals no more than in one copy.

At scale: only texts with personal data are shuffled. Document frequencies of all words are aggregated
within tasks first. Entities that stand in the same documents disclose alike, and so do terms of equal frequency that
stand in the same documents with personal data: sets of either kind (by 128 bits over their documents) stand for
their members, so all the addresses and words of a document that occur nowhere else are one pair. Of a document's
sets only those pairs become rows that would exceed GENERALISE if every document of the rarer of the two held both;
no other pair can, so none is missed. What is left are sets that differ: a document that shares each of its
entities and each of its words with another document has as many pairs as these multiply to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, materialise, table

#: Fixed patterns of the base kinds, in order; look-behinds and possessive quantifiers keep them linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20\-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}
#: A text without it has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
KINDS = list(PATTERNS)
IP_PARTS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"

#: Documents that a term counts more than it is in, and shares of an entity's information.
UNSEEN, GENERALISE, REMOVE = 0.5, 0.8, 0.95
#: Longest word that is a term.
LONGEST = 64
WORD = r"[\p{L}\p{M}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{M}\p{N}_]+"

SPAN = "struct<start:int,ord:int,end:int,value:string>"


def luhn(digits: Column) -> Column:
    """Of a string of digits."""
    n = F.length(digits)

    def digit(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = d * 2
        return F.when(i % 2 == 1, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + digit(i)) % 10 == 0


def accepted(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(digits)).otherwise(False)
    return (n >= 10) & (n <= 15) if kind == "phone" else F.lit(True)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def largest(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0))


def running(values: Column, merge: Callable[[Column], Column]) -> Column:
    """merge (total or largest) of all values before each; by blocks of the root of their number, so no step goes over all that came before."""
    size = lambda v: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v)))).cast("int")
    whole = lambda i, b: F.floor(i / b).cast("int")
    one = F.transform(F.array(values), lambda v: F.struct(v.alias("v"), size(v).alias("b")))
    two = F.transform(one, lambda x: F.struct(x["v"].alias("v"), x["b"].alias("b"), F.transform(F.sequence(F.lit(0), whole(F.size(x["v"]), x["b"])), lambda k: merge(F.slice(x["v"], k * x["b"] + 1, x["b"]))).alias("blocks")))
    three = F.transform(two, lambda x: F.struct(x["v"].alias("v"), x["b"].alias("b"), F.transform(x["blocks"], lambda _, k: merge(F.slice(x["blocks"], F.lit(1), k))).alias("before")))
    each = lambda x, i: merge(F.array(F.get(x["before"], whole(i, x["b"])), merge(F.slice(x["v"], whole(i, x["b"]) * x["b"] + 1, i % x["b"]))))
    return F.transform(three, lambda x: F.transform(x["v"], lambda _, i: each(x, i)))[0]


def located(text: Column, pattern: str) -> Column:
    """(start, value) of every match in order, in code points."""


    def ends(pair: Column) -> Column:
        lengths = F.zip_with(pair["gaps"], pair["found"], lambda gap, value: F.length(gap) + F.coalesce(F.length(value), F.lit(0)))
        return F.struct(pair["found"].alias("found"), pair["gaps"].alias("gaps"), running(lengths, total).alias("before"))

    def starts(x: Column) -> Column:
        return F.transform(x["found"], lambda value, i: F.struct((F.get(x["before"], i) + F.length(F.get(x["gaps"], i))).alias("start"), value.alias("value")))

    # both arrays as one value, so that no lambda applies the pattern again
    pair = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")))
    return F.when(text.rlike(pattern), F.transform(F.transform(pair, ends), starts)[0]).otherwise(F.array().cast("array<struct<start:int,value:string>>"))


def spans_of(text: Column, k: int) -> Column:
    """Accepted matches of the kind of number k."""
    kind, none = KINDS[k], F.array().cast("array<struct<start:int,value:string>>")
    found = located(text, PATTERNS[kind])
    if kind in NEEDS:
        found = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(none)
    kept = F.filter(found, lambda x: accepted(kind, x["value"]))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("ord"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """Array of SPAN by start, then kind; ord is the kind's place in KINDS."""
    return F.array_sort(F.concat(*(spans_of(text, k) for k in range(len(KINDS)))))


def number_of(spans: Column, k: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["ord"] == k)).cast("bigint")


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in [*KINDS, "term"]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"], s["end"])), ",")


def copy_of(text: Column) -> Column:
    """Equal for equal texts only."""
    return F.concat_ws(":", F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(1), text)))


def key_of(id_: Column, text: Column) -> Column:
    """Equal for rows of equal id and text only."""
    return F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), copy_of(text))


def found_in(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, doc_id, copy, base spans and, where there are any, the text; in the shared folder."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", key_of(F.col("doc_id"), F.col("text")).alias("key"), copy_of(F.col("text")).alias("copy"), base_spans(F.col("text")).alias("base"))
    return materialise(rows.select("key", "doc_id", "copy", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "base")


def words_of(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), NOT_WORD))


def share_of(n_et: Column, n_e: Column, df: Column, n: float) -> Column:
    """d(e, t) by numbers of documents."""
    info = -F.log2(n_e / F.lit(n))
    return F.when(info > 0, F.log2(n_et * F.lit(n) / (n_e * (df + F.lit(UNSEEN)))) / info).otherwise(0.0)


def disclosing(found: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """copy, terms (start, end, disclosed) that exceed GENERALISE and touch no base span, in order, of the texts that hold any."""
    held = found.where(F.size("base") > 0)
    held = materialise(held.groupBy("copy").agg(F.count("*").alias("copies"), F.first("text").alias("text"), F.first("base").alias("base")), "held")
    entities = held.select("copy", F.explode(F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["ord"], F.lower(s["value"]))))).alias("entity"))
    words = held.select("copy", "copies", F.explode(words_of(F.col("text"))).alias("term")).where(F.length("term").between(2, LONGEST) & ~F.col("term").rlike("^[0-9]+$"))
    in_set = [F.bit_xor(F.xxhash64(F.lit(i), F.col("copy"))) for i in range(2)]

    with_text = docs.select(F.col(text_col).cast("string").alias("text"))
    # all documents less the further copies of those with personal data
    n = float(max(1, with_text.count() - (held.agg(F.sum(F.col("copies") - 1)).first()[0] or 0)))
    # entities of one set of documents disclose alike, and so do terms: pairs are of sets
    of_entity = entities.groupBy("entity").agg(F.count("*").alias("n_e"), in_set[0].alias("e0"), in_set[1].alias("e1"))
    e_set, t_set = ["n_e", "e0", "e1"], ["df", "t0", "t1"]
    further = words.groupBy("term").agg(F.sum(F.col("copies") - 1).alias("further"), in_set[0].alias("t0"), in_set[1].alias("t1"))
    frequency = with_text.select(F.explode(words_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # an inner join stays above the aggregation: a semi-join would go below it and give a row per occurrence
    frequency = materialise(frequency.join(further.hint("merge"), "term").select("term", (F.col("df") - F.col("further")).alias("df"), "t0", "t1"), "terms")
    held_words = materialise(words.join(frequency.hint("merge"), "term").select("copy", "term", *t_set), "words")
    right = entities.join(of_entity.hint("merge"), "entity").select(F.col("copy").alias("in_copy"), *e_set).distinct()
    possible = share_of(F.least("n_e", "df"), F.col("n_e"), F.col("df"), n) >= GENERALISE
    pairs = held_words.select("copy", *t_set).distinct().join(right.hint("merge"), (F.col("copy") == F.col("in_copy")) & possible).drop("in_copy")
    pairs = materialise(pairs, "pairs")
    verdicts = pairs.groupBy(*e_set, *t_set).agg(F.count("*").alias("n_et")).withColumn("disclosed", share_of(F.col("n_et"), F.col("n_e"), F.col("df"), n))
    verdicts = verdicts.where(F.col("disclosed") >= GENERALISE).drop("n_et")
    of_copy = pairs.join(verdicts.hint("merge"), [*e_set, *t_set]).groupBy("copy", *t_set).agg(F.max("disclosed").alias("disclosed"))
    terms = materialise(held_words.join(of_copy.hint("merge"), ["copy", *t_set]).select("copy", "term", "disclosed"), "disclosed")
    discard(pairs, held_words, frequency)
    texts = held.join(terms.select("copy").distinct().hint("merge"), "copy")
    at = texts.select("copy", F.explode(located(F.col("text"), WORD)).alias("w"))
    at = at.select("copy", F.col("w.start").alias("start"), (F.col("w.start") + F.length("w.value")).alias("end"), F.lower("w.value").alias("term")).join(terms.hint("merge"), ["copy", "term"])
    return untouched(at.select("copy", "start", "end", "disclosed"), texts.select("copy", F.explode("base").alias("b")).select("copy", "b.start", "b.end"))


def untouched(terms: DataFrame, base: DataFrame) -> DataFrame:
    """copy, terms: those (start, end, disclosed) that overlap no base span (start, end) of the copy, in order.

    In the order of the terms' ends and the spans' starts a term overlaps if a span before it ends behind its start.
    """
    none = F.lit(None)
    events = terms.select("copy", F.col("end").alias("at"), F.lit(0).alias("kind"), none.cast("int").alias("reach"), F.struct("start", F.lit(len(KINDS)).alias("ord"), "end", "disclosed").alias("term"))
    spans = base.select("copy", F.col("start").alias("at"), F.lit(1).alias("kind"), F.col("end").alias("reach"), none.cast(events.schema["term"].dataType).alias("term"))
    before = Window.partitionBy("copy").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.unionByName(spans).withColumn("reached", F.coalesce(F.max("reach").over(before), F.lit(0))).where("term is not null and reached <= term.start")
    return rows.groupBy("copy").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def all_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, doc_id, base and terms, the latter with their disclosed share; a term that touches a base span is no span of its own."""
    found = found_in(docs, id_col, text_col)
    extra = disclosing(found, docs, text_col)
    return found.drop("text").join(extra.hint("merge"), "copy", "left").select("key", "doc_id", "base", F.coalesce("terms", F.array().cast("array<struct<start:int,ord:int,end:int,disclosed:double>>")).alias("terms"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row.

    A null text counts as empty: no spans, the digest of no bytes. Equal rows give equal rows; an
    empty table gives none; only the two columns named are read.
    """
    bare = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end")))
    rows = all_spans(docs, id_col, text_col)
    counts = [number_of(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat(bare(F.col("base")), bare(F.col("terms"))))).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with all their columns, personal data in the text replaced: base spans by [KIND], terms by their shape or nothing. A null text stays null."""
    spans = all_spans(docs, id_col, text_col).where((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["key"])
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    value = F.lit(None).cast("string")
    marks = F.array_sort(F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(labels, s["ord"] + 1).alias("label"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["disclosed"] >= REMOVE, F.lit("")).otherwise(value).alias("label"))),
    ))
    named = "corpusloom_key", "corpusloom_marks"
    rows = docs.withColumn(named[0], key_of(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    rows = rows.join(spans.select(F.col("key").alias(named[0]), marks.alias(named[1])), named[0], "left")
    text, marks = F.col(text_col).cast("string"), F.col(named[1])
    ends = F.transform(marks, lambda m: m["end"])

    def piece(m: Column, last: Column) -> Column:
        start, shape = F.greatest(m["start"], last), F.when(F.substring(text, m["start"] + 1, F.lit(1)).rlike(r"\p{N}"), F.lit("[NUMBER]")).otherwise(F.lit("[WORD]"))
        return F.concat(F.substring(text, last + 1, start - last), F.when(m["end"] > last, F.coalesce(m["label"], shape)).otherwise(""))

    # the end of all marks before each, as marks of different kinds may overlap
    clean = F.concat(F.array_join(F.zip_with(marks, running(ends, largest), piece), ""), F.substring(text, largest(ends) + 1, F.length(text)))
    return rows.withColumn(text_col, F.when(marks.isNull() | text.isNull(), text).otherwise(clean)).drop(*named)


def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
