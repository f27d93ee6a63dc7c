"""Personal data: patterns for entities, and terms whose company in the corpus gives an entity away."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import GAPS, let, stored, table

#: Patterns of the base kinds. Each starts at the end of the last match or where its first characters begin, and never
#: gives characters back: the leftmost matches stay the same, and long runs take one step per character.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Characters beside an entity that its company is taken from, and words of them on either side.
BESIDE_CHARS, BESIDE_WORDS = 80, 3
#: Different surroundings that a term must share with an entity, and the share of the entity's own information that a
#: term must give away to be disclosing.
LEAST_CONTEXTS, DISCLOSURE = 3, 0.95
#: What lies between words, in an entity's company as in the corpus.
NO_WORD = r"[^\p{L}\p{N}]+"
SPAN = "array<struct<start:int,stop:int,text:string>>"


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether the check sum of a string of digits holds."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(number, i, F.lit(1)).cast("int")
        twice = 2 * digit
        return total + F.when((n - i) % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def real_ip(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda d: (F.length(d) <= 3) & (
        F.lpad(d, 3, "0") <= "255")))


def real_card(text: Column) -> Column:
    number = digits_of(text)
    return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(F.lit(False))


def real_phone(text: Column) -> Column:
    return F.length(digits_of(text)).between(9, 15)


#: kind -> (pattern, character or class that a text must hold, test of a match, form that equal entities share)
KINDS: dict[str, tuple[str, str, Callable, Callable]] = {
    "email": (EMAIL, "@", lambda m: F.lit(True), F.lower),
    "ip": (IP, r"[0-9]\.[0-9]", real_ip, lambda m: m),
    "card": (CARD, r"[0-9][\x20-]?[0-9]", real_card, digits_of),
    "phone": (PHONE, r"\+[0-9]", real_phone, digits_of),
}


def matches(text: Column, pattern: Column, likely: Column, real: Callable) -> Column:
    """(start, stop, text) of the matches of a pattern that pass the test, in code points, stop exclusive.

    Positions are sums over the matches and what the text splits into between them.
    """
    nothing = F.array().cast(SPAN)

    def put(done: Column, part: Column) -> Column:
        start = done.at + F.length(part.gap)
        stop = start + F.length(part.hit)
        return F.struct(stop.alias("at"), F.when(part.hit.isNotNull() & real(part.hit), F.concat(
            done.found, F.array(F.struct(start.alias("start"), stop.alias("stop"), part.hit.alias("text"))).cast(SPAN)))
            .otherwise(done.found).alias("found"))

    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))
    first = F.struct(F.lit(0).alias("at"), nothing.alias("found"))
    return F.when(likely, F.aggregate(F.slice(parts, 1, F.size(parts) - 1), first, put, lambda s: s.found)).otherwise(
        nothing)


def named(found: Column, no: int, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(
        s.start.alias("start"), F.lit(no).alias("no"), F.lit(kind).alias("kind"), s.stop.alias("stop"),
        s.text.alias("text")))


def base_spans(docs: DataFrame) -> DataFrame:
    """The rows of docs with `found`: (start, kind number, kind, stop, text) of all real matches, sorted.

    NULL and empty texts have none. Kinds are looked for one by one, so spans of different kinds may overlap.
    """
    text, parts = F.coalesce("text", F.lit("")), []
    for k, (kind, (pattern, must, real, _)) in enumerate(KINDS.items()):
        likely = F.contains(text, F.lit(must)) if kind == "email" else text.rlike(must)
        parts.append(named(matches(text, F.lit(pattern), likely, real), k, kind))
    return docs.withColumn("found", F.array_sort(F.concat(*parts)))


def words_in(text: Column) -> Column:
    """The words of a text, runs of letters and digits, lower case."""
    return F.array_remove(F.split(F.lower(text), NO_WORD), "")


def words_beside(text: Column, last: bool) -> Column:
    """The words, in order, of the BESIDE_WORDS nearest between white space in a piece of text beside an entity.

    The piece has BESIDE_CHARS + 1 characters at most. What runs into the entity, or is cut at a full piece's far end, is
    no word.
    """
    near, far = (r"[\p{L}\p{N}]+$", r"^[\p{L}\p{N}]+") if last else (r"^[\p{L}\p{N}]+", r"[\p{L}\p{N}]+$")
    whole = F.regexp_replace(F.when(F.length(text) > BESIDE_CHARS, F.regexp_replace(text, far, "")).otherwise(text), near, "")
    spaced = F.filter(F.split(whole, GAPS), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    return words_in(F.array_join(let(spaced, lambda w: F.slice(
        w, F.greatest(F.lit(1), F.size(w) - BESIDE_WORDS + 1) if last else F.lit(1), F.lit(BESIDE_WORDS))), " "))


def following_words(words: Column) -> Column:
    """(term, next) of each word: `next` is the digest of the word after it, NULL for the last."""
    return F.transform(words, lambda x, i: F.struct(x.alias("term"), F.when(
        i + 1 < F.size(words), F.xxhash64(F.get(words, i + 1))).alias("next")))


def disclosing_terms(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(term): terms that give an entity of the corpus away.

    Entities are the base matches. A term's company is counted in different surroundings, so copies of a text count
    once. With N surroundings, c of the entity, o of the term in the whole corpus and b of both, the term discloses
    log(N b / (c o)) out of the entity's log(N / c); from DISCLOSURE of it on, and with LEAST_CONTEXTS surroundings, it
    goes. Occurrences o are counted over all documents, in different word pairs that the term begins.
    """
    entity = F.coalesce(*(F.when(F.col("s.kind") == kind, F.concat(F.lit(kind + ":"), form(F.col("s.text"))))
                          for kind, (_, _, _, form) in KINDS.items()))
    start = F.greatest(F.col("s.start") - BESIDE_CHARS - 1, F.lit(0))
    before = F.substring(F.col("text"), start + 1, F.col("s.start") - start)
    after = F.substring(F.col("text"), F.col("s.stop") + 1, F.lit(BESIDE_CHARS + 1))
    seen = spans.select("text", F.explode("found").alias("s")).select(entity.alias("entity"), F.array(
        words_beside(before, True), words_beside(after, False)).alias("near"))
    told = stored(seen.select("entity", "near", F.xxhash64("near").alias("context")).distinct(), "company")
    sizes = told.groupBy("entity").agg(F.count("*").alias("c"))
    n = told.agg(F.count("*").alias("N")).first().N
    company = told.select("entity", "context", F.explode(F.array_distinct(F.flatten("near"))).alias("term"))
    beginning = F.flatten(F.transform("near", lambda w: F.filter(following_words(w), lambda p: p.next.isNotNull())))
    beside = told.select(F.explode(beginning).alias("p")).select("p.term", "p.next").distinct().groupBy("term").agg(
        F.count("*").alias("beside"))
    # b surroundings disclose only if the term occurs at most b * (N / c) ** (1 - DISCLOSURE) times (never under b). The
    # word pairs that it begins beside entities are some of those in the corpus: a term with too many of them goes before
    # the corpus is searched, and no other. Entities with few surroundings can have no term with enough of them.
    most = F.col("b") * F.pow(n / F.col("c"), F.lit(1 - DISCLOSURE))
    pairs = stored(company.join(sizes.where(F.col("c") >= LEAST_CONTEXTS), "entity").groupBy("entity", "term").agg(
        F.first("c").alias("c"), F.count("*").alias("b")).where(F.col("b") >= LEAST_CONTEXTS).join(
        beside, "term", "left").where((F.col("c") < n) & (F.coalesce("beside", F.lit(0)) <= most)), "pairs")
    if pairs.isEmpty():
        return pairs.select("term")
    following = let(words_in(F.coalesce("text", F.lit(""))), following_words)
    wanted = pairs.select("term").distinct()
    occurring = docs.select(F.explode(following).alias("p")).select("p.term", "p.next").join(wanted, "term").distinct()
    often = occurring.groupBy("term").agg(F.count("*").alias("o"))
    return pairs.join(often, "term").where(F.col("o") <= most).select("term").distinct()


def with_terms(spans: DataFrame, terms: DataFrame) -> DataFrame:
    """Add `terms`: (start, kind number, kind, stop, text) of the disclosing terms in each text of (text, found).

    Texts are matched with the terms by their words; a text is known by two digests, so copies share the work.
    """
    words = F.array_distinct(words_in(F.coalesce("text", F.lit(""))))
    key = [F.xxhash64("text").alias("h1"), F.crc32(F.coalesce("text", F.lit(""))).alias("h2")]
    held = spans.select(*key, F.explode(words).alias("term")).join(terms, "term").groupBy("h1", "h2").agg(
        F.array_sort(F.collect_set("term")).alias("held"))
    keyed = spans.withColumns({"h1": F.xxhash64("text"), "h2": F.crc32(F.coalesce("text", F.lit("")))}).join(
        held, ["h1", "h2"], "left").drop("h1", "h2")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("held", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    found = matches(F.col("text"), pattern, F.col("held").isNotNull(), lambda m: F.lit(True))
    return keyed.withColumn("terms", named(found, len(KINDS), "term")).drop("held")


def spans_of(docs: DataFrame) -> DataFrame:
    """The rows of docs with `found` (base spans) and `terms` (disclosing terms), both sorted."""
    spans = base_spans(docs)
    terms = stored(disclosing_terms(docs, spans), "terms")
    if terms.isEmpty():
        return spans.withColumn("terms", F.slice("found", 1, 0))
    return with_terms(spans, terms)


def sanitised(docs: DataFrame) -> DataFrame:
    """The documents with entities generalised to their kind, `<EMAIL>`, and disclosing terms removed to `<TERM>`.

    Where spans overlap the one that starts first wins, then the kind listed first. Other columns stay, but n_chars,
    if there is one, follows the text; NULL texts stay NULL.
    """
    def put(done: Column, s: Column) -> Column:
        later = s.start >= done.at
        return F.struct(
            F.when(later, s.stop).otherwise(done.at).alias("at"),
            F.when(later, F.concat(done.out, F.substring(F.col("text"), done.at + 1, s.start - done.at), F.lit("<"),
                                   F.upper(s.kind), F.lit(">"))).otherwise(done.out).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(F.array_sort(F.concat("found", "terms")), first, put, lambda d: F.concat(
        d.out, F.substring(F.col("text"), d.at + 1, F.length("text"))))
    # The row travels as one column, so that its columns may have any names.
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    clean = spans_of(rows).withColumn("text", F.when(F.size("found") + F.size("terms") > 0, whole).otherwise(
        F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "row.n_chars")
    return clean.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")


def op10_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digest, and all spans with disclosing terms."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias(
        "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return spans_of(docs).select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("found")), 256).alias("base_sha256"), listed(
        F.array_sort(F.concat("found", "terms"))).alias("spans"))
