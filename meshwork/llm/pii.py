"""Personal data by bootstrapped contextual extraction, in DataFrame operations.

Base entities are found by fixed patterns (email, ip, card, phone); they are
the seeds. What surrounds a seed is a lexical pattern (the two words before
it; the word before and the word after it; whole words, long ones by their
hash). Other identifier-like strings (letters, digits, ``-`` and ``_``; six or
more characters, four or more digits; also with single blanks, dots or slashes
between digits) that do not overlap a seed are candidates and have patterns of
the same kinds. Patterns and instances (different values) form a graph:

* a pattern's confidence in a kind is the sum of its instances' scores for
  the kind over half more than the number of its instances, if ``SUPPORT`` or
  more different seeds of that kind have it (else 0). Instances count whatever
  their kind, so seeds of other kinds lower the confidence;
* a candidate's score for a kind is 1 - prod(1 - confidence) over its
  patterns; a seed scores 1 for its own kind and 0 for others.

Scores start at 0, grow from round to round and are iterated until none
changes by more than one part in ``1 / tolerance``; there is no limit on the
rounds. Candidates that have a single supported pattern score what it is
confident; that linear part is solved at once, so a template with very many
unseen identifiers takes no more rounds than one with few. Candidates of a
score of ``threshold`` or more are personal data of that kind wherever they
occur. Only patterns with both enough seeds and a candidate enter the rounds.
All tables are aggregated by pattern, value or document with map-side
combining; joins with the small pattern table can be split where a pattern is
hot.

Positions are code points, ends exclusive. To keep Java's matcher linear and
flat on any text, single separators between digits (card, candidates) and dots
between label characters (email) are first replaced by one control character
each, and a match begins only where a run begins or the last match ended; that
gives the leftmost non-overlapping matches of the patterns as stated. Places
of matches are sums over blocks of matches, and a text is redacted from blocks
of its characters, so the work grows with the text and its matches, not with
their product.

Edge cases: null and empty texts have no spans; a failing match is dropped
and not tried again at a later start; words of a context that a neighbouring
match cuts off are missing; repeated rows are judged one by one; an empty
table gives an empty result; extra columns, whatever their names, are ignored
or, in ``redact``, kept.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
#: Longer words of a context stand as their hash.
LONG_WORD = 60
#: Elements that are added up in one array, characters of a block of text.
BLOCK, PAGE = 256, 4096

_MARK, _OTHER = "\u0001", "\u0002"
_LOCAL = "A-Za-z0-9._%+\u0001-"
_EMAIL = (f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++\u0001[A-Za-z0-9\u0001-]*+")
_IP = "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
_CARD = "[0-9][0-9\u0001]{11,}+"
_PHONE = "\\+[0-9][ ().0-9-]+[0-9]"
_DIGIT4 = "(?:[A-Za-z_-]*+[0-9]){4}"
_CANDIDATE = f"(?<![A-Za-z0-9_-])(?={_DIGIT4})[A-Za-z0-9_-]{{6,}}+"
#: The same with marks between digits; runs without any are left to the other.
_JOINED = ("(?<![A-Za-z0-9_\u0001-])(?=[A-Za-z0-9_-]++\u0001)(?=(?:[A-Za-z_\u0001-]*+[0-9]){4})"
           "[A-Za-z0-9_\u0001-]{6,}+")


def _marked(text: Column, pattern: str) -> Column:
    return F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, _MARK)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    place = F.sequence(F.lit(1), F.length(digits))
    reverse = F.reverse(digits)

    def add(total, i):
        d = F.substring(reverse, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(place, F.lit(0), add) % 10 == 0


def _valid_ip(hit):
    part = lambda p: F.coalesce(F.when(F.length(p) > 0, p), F.lit("0"))
    bare = lambda p: part(F.regexp_replace(p, "^0+", ""))
    return F.forall(F.split(hit, "\\."), lambda p: (F.length(bare(p)) <= 3) & (bare(p).cast("int") <= 255))


def _valid_card(hit):
    d = _digits(hit)
    return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))


def _valid_phone(hit):
    return F.length(_digits(hit)).between(9, 15)


def _prefix(values: Column, add, zero: Column) -> Column:
    """For every element what ``add`` makes of those before it, in blocks: an
    array is appended to at most ``BLOCK`` times."""
    def running(part, first):
        return F.aggregate(part, F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("all")),
                           lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
                           lambda acc: acc["all"])
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
    part = lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))
    totals = F.transform(blocks, lambda b: F.aggregate(part(b), zero, add))
    firsts = running(totals, zero)
    return F.when(F.size(values) > 0, F.flatten(F.transform(blocks, lambda b: running(part(b), F.element_at(firsts, b + 1)))))


def _located(df: DataFrame, name: str, guard: Column, text: Column, pattern: str, valid) -> DataFrame:
    """Column ``name``: the matches with place, value and the words around.
    The text between matches gives places and words, in one pass over it."""
    t, hits, gaps, steps, starts = (f"{name}_{x}" for x in ("t", "h", "g", "n", "s"))
    df = df.withColumn(t, F.when(guard, text))
    df = df.withColumns({hits: F.when(F.col(t).isNotNull(), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))),
                         gaps: F.when(F.col(t).isNotNull(), F.split(t, pattern, -1))}).drop(t)
    length = lambda x: F.length(x).cast("long")
    df = df.withColumn(steps, F.transform(hits, lambda h, i: length(F.element_at(gaps, i + 1)) + length(h)))
    df = df.withColumn(starts, F.when(F.size(hits) > 0, _prefix(
        F.col(steps), lambda at, n: at + n, F.lit(0).cast("long"))))

    def word(x):
        return F.when(F.length(x) > LONG_WORD, F.sha2(x, 256)).otherwise(x)

    def found(at, i):
        hit, gap = F.element_at(hits, i + 1), F.element_at(gaps, i + 1)
        start = at + length(gap)
        before = F.filter(F.split(F.lower(gap), "\\s+"), lambda w: w != "")
        after = F.regexp_extract(F.lower(F.element_at(gaps, i + 2)), "(\\S++)", 1)
        last = lambda n: word(F.try_element_at(before, F.lit(-n)))
        return F.struct(start.alias("start"), (start + length(hit)).alias("end"), hit.alias("value"),
                        last(2).alias("two"), last(1).alias("one"), word(after).alias("after"))
    df = df.withColumn(name, F.when(F.col(starts).isNotNull(), F.transform(starts, found)))
    if valid is not None:
        df = df.withColumn(name, F.filter(name, lambda x: valid(x["value"])))
    return df.drop(hits, gaps, steps, starts)


def base_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows as struct ``row`` with arrays ``email``, ``ip``, ``card``,
    ``phone`` (the base entities), ``other`` and ``joined`` (candidates that
    may overlap them)."""
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    df = _located(df, "email", text.contains("@"),
                  _marked(text, "(?<=[A-Za-z0-9-])\\.(?=[A-Za-z0-9-])"), _EMAIL, None)
    df = df.withColumn("numbers", text.rlike("[0-9]"))
    digit = F.col("numbers")
    df = _located(df, "ip", digit & text.rlike("[0-9]\\.[0-9]"), text, _IP, _valid_ip)
    df = _located(df, "card", digit & text.rlike("[0-9][0-9 -]{10,}[0-9]"),
                  _marked(text, "(?<=[0-9])[ -](?=[0-9])"), _CARD, _valid_card)
    df = _located(df, "phone", digit & text.contains("+"), text, _PHONE, _valid_phone)
    df = _located(df, "other", digit, text, _CANDIDATE, None)
    df = _located(df, "joined", digit & text.rlike("[0-9][ ./][0-9]"),
                  _marked(text, "(?<=[0-9])[ ./](?=[0-9])"), _JOINED, None)
    return df.drop("text", "numbers")


def _occurrences(table: DataFrame) -> DataFrame:
    """One row per entity or candidate: id of the row, kind (-1: candidate),
    place, value and its patterns; candidates that overlap an entity are left out."""
    def tagged(column, kind):
        return F.transform(F.coalesce(F.col(column), F.array()), lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
            F.lower(x["value"]).alias("value"), x["two"].alias("two"), x["one"].alias("one"), x["after"].alias("after")))
    every = F.concat(*(tagged(k, i) for i, k in enumerate(KINDS)), tagged("other", -1), tagged("joined", -1))
    rows = table.select("id", F.explode(every).alias("x")).select("id", "x.*")
    # of one document's entities: the last end before a candidate's start, the first start after it
    # (both run forward, the second over the opposite order: one step a row)
    place = ("start", "end", "kind")
    seed, so_far = F.col("kind") >= 0, (Window.unboundedPreceding, -1)
    until = F.max(F.when(seed, F.col("end"))).over(Window.partitionBy("id").orderBy(*place).rowsBetween(*so_far))
    following = F.min(F.when(seed, F.col("start"))).over(
        Window.partitionBy("id").orderBy(*map(F.desc, place)).rowsBetween(*so_far))
    rows = rows.withColumns({"until": until, "following": following}).where(
        seed | ((F.coalesce("until", F.lit(0)) <= F.col("start")) & (F.coalesce("following", F.col("end")) >= F.col("end"))))
    two = F.when(F.col("two").isNotNull(), F.concat(F.lit("2 "), "two", F.lit(" "), "one"))
    around = F.when(F.col("one").isNotNull() & (F.col("after") != ""), F.concat(F.lit("1 "), "one", F.lit(" "), "after"))
    return rows.select("id", "kind", "start", "end", "value",
                       F.filter(F.array(two, around), lambda p: p.isNotNull()).alias("patterns"))


def _score(rows: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(value, kind) of the candidates that are personal data."""
    kinds = range(len(KINDS))
    edges = rows.select("kind", "value", F.explode("patterns").alias("pattern")).distinct()
    seeds = [F.count(F.when(F.col("kind") == i, 1)).alias(f"seeds{i}") for i in kinds]
    useful = edges.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("size"), F.count(F.when(F.col("kind") < 0, 1)).alias("open"), *seeds)
    useful = useful.where((F.col("open") > 0) & (F.greatest(*(f"seeds{i}" for i in kinds)) >= SUPPORT))
    useful = materialise(useful, narrow=True)
    supported = lambda i: F.col(f"seeds{i}") >= SUPPORT
    open_ = edges.where("kind < 0").join(useful, "pattern").select(
        "value", "pattern", *(supported(i).alias(f"w{i}") for i in kinds))
    # a candidate with one supported pattern of a kind scores its confidence
    degree = open_.groupBy("value").agg(*(F.count_if(f"w{i}").alias(f"d{i}") for i in kinds))
    open_ = materialise(open_.join(degree, "value").select(
        "value", "pattern", *((F.col(f"w{i}") & (F.col(f"d{i}") == 1)).alias(f"only{i}") for i in kinds)), narrow=True)
    private = open_.groupBy("pattern").agg(*(F.count_if(f"only{i}").alias(f"p{i}") for i in kinds))
    useful = materialise(useful.join(private, "pattern"), narrow=True)
    scores = open_.select("value").distinct().select("value", *(F.lit(0.0).alias(f"s{i}") for i in kinds))
    changing = not open_.isEmpty()
    while changing:
        gained = open_.join(scores, "value").groupBy("pattern").agg(
            *(F.sum(F.when(~F.col(f"only{i}"), F.col(f"s{i}")).otherwise(0.0)).alias(f"g{i}") for i in kinds))
        trust = [F.when(supported(i), (F.col(f"seeds{i}") + F.col(f"g{i}")) / (F.col("size") + 0.5 - F.col(f"p{i}")))
                 .otherwise(0.0).alias(f"c{i}") for i in kinds]
        patterns = materialise(useful.join(gained, "pattern").select("pattern", *trust), narrow=True)
        miss = lambda i: F.sum(F.log1p(-F.least(F.col(f"c{i}"), F.lit(1 - 1e-9))))
        now = open_.join(patterns, "pattern").groupBy("value").agg(*((1 - F.exp(miss(i))).alias(f"s{i}") for i in kinds))
        moved = [F.col(f"n.s{i}") - F.col(f"o.s{i}") > tolerance * F.col(f"n.s{i}") for i in kinds]
        now = materialise(now.alias("n").join(scores.alias("o"), F.col("n.value") == F.col("o.value")).select(
            "n.*", F.exists(F.array(*moved), lambda x: x).alias("moved")), narrow=True)
        changing = not now.where("moved").isEmpty()
        scores = now.drop("moved")
    best = F.array_max(F.array(*(F.struct(F.col(f"s{i}").alias("s"), F.lit(-i).alias("i")) for i in kinds)))
    return scores.select("value", best.alias("best")).where(F.col("best.s") >= threshold).select(
        "value", (-F.col("best.i")).alias("kind"))


def _spans(*columns) -> Column:
    """Sorted spans (start, kind number, end) of base arrays."""
    def spans(column, kind):
        return F.transform(F.coalesce(F.col(column), F.array()), lambda x: F.struct(
            x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    return F.array_sort(F.concat(*(spans(c, i) for i, c in enumerate(columns))))


def with_spans(docs: DataFrame, text_col: str = "text", threshold: float = 0.8, tolerance: float = 1e-4,
               keep: list[str] | None = None) -> DataFrame:
    """``row`` (columns ``keep``, all by default), ``base`` and ``found``, the
    spans (start, kind number, end) of base entities and of what their
    contexts led to."""
    columns = docs.columns if keep is None else keep
    table = base_entities(docs, text_col).withColumn("id", F.monotonically_increasing_id())
    kept = F.struct(*(F.col("row").getField(c).alias(c) for c in columns)).alias("row")
    table = materialise(table.select("id", kept, *KINDS, "other", "joined", _spans(*KINDS).alias("base")))
    rows = materialise(_occurrences(table.select("id", *KINDS, "other", "joined")), narrow=True)
    known = _score(rows, threshold, tolerance)
    found = rows.where("kind < 0").drop("kind", "patterns").join(known, "value").groupBy("id").agg(
        F.collect_set(F.struct("start", "kind", "end")).alias("found"))
    # stored: where little was found the texts stay in place
    found = materialise(found, narrow=True)
    return table.select("id", "row", "base").join(found, "id", "left").select(
        "row", "base", F.coalesce("found", F.array()).alias("found"))


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each document."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # the text is read, not kept
    found = with_spans(texts, keep=["doc_id"], **options)

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return found.select("row.doc_id", *map(count, range(len(KINDS))), F.sha2(_text(F.col("base")), 256).alias("base_sha256"),
                        _text(F.array_sort(F.concat("base", "found"))).alias("spans"))


def _between(pages: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` of a text cut into pages."""
    start, end = start.cast("int"), end.cast("int")
    first, last = (start / PAGE).cast("int"), (end / PAGE).cast("int")
    page = lambda i: F.coalesce(F.try_element_at(pages, i + 1), F.lit(""))
    at = start - first * PAGE + 1
    return F.when(start >= end, "").when(first == last, F.substring(page(first), at, end - start)).otherwise(F.concat(
        F.substring(page(first), at, F.lit(PAGE)), F.array_join(F.slice(pages, first + 2, last - first - 1), ""),
        F.substring(page(last), F.lit(1), end - last * PAGE)))


def redact(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents with every span (overlapping ones as one) replaced by
    its kind in angle brackets; ``n_chars``, if there, is the new length."""
    found = with_spans(docs, text_col, **options)
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    text = F.col("row").getField(text_col)
    found = found.withColumn("spans", F.array_sort(F.concat("base", "found")))
    found = found.withColumn("ends", F.transform("spans", lambda s: s["end"]))
    has = F.size("spans") > 0
    found = found.withColumns({
        "until": F.when(has, _prefix(F.col("ends"), lambda at, e: F.greatest(at, e), F.lit(0).cast("long"))),
        "pages": F.when(has, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0)))})
    pages = F.col("pages")
    # a span that starts before the end of the ones before it is part of theirs
    parts = F.transform("spans", lambda s, i: F.when(s["start"] >= F.element_at("until", i + 1), F.concat(
        _between(pages, F.element_at("until", i + 1), s["start"]), F.element_at(names, s["kind"] + 1))).otherwise(""))
    rest = _between(pages, F.array_max("ends"), F.length(text))
    found = found.withColumn("clean", F.when(has, F.concat(F.array_join(parts, ""), rest)).otherwise(text))
    changed = {text_col: F.col("clean")}
    if "n_chars" in docs.columns:
        old = F.col("row").getField("n_chars")
        changed["n_chars"] = F.when(has, F.length("clean")).otherwise(old).cast(docs.schema["n_chars"].dataType)
    return found.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
