"""Sanitising by disclosed information: personal data, and the terms that give it away, with DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers, leftmost and non-overlapping within a kind; matches that fail their test
(parts, digits, Luhn) are dropped. Their values are the protected entities. What else gives an entity away is estimated from the corpus:

1. Every entity's windows, ``WINDOW`` words on either side, are read off the gaps between matches. Documents are counted by entity,
   and by entity and term in its windows; a pair is evidence if it occurs in at least ``LEAST_WINDOWS`` different windows, so neither chance nor copies
   of a text make it.
2. Terms of such pairs are counted over all documents.
3. A term's pointwise mutual information with an entity, divided by the entity's own information, -log p(entity), is the share of the
   entity that the term discloses: 1 if every document with the term has the entity. In the documents that hold an entity, the terms that disclose
   ``GENERALISE_AT`` of it or more are generalised, those that disclose ``REMOVE_AT`` are removed, wherever they stand in the text. With ``everywhere`` that is done in
   all documents, also where only the term would tell of the entity.

Counts are pre-aggregated before they are exchanged, so an entity or a term of any frequency leaves one row a task; texts are scanned
again in each pass rather than moved. The disclosing terms are broadcast up to ``BROADCAST_BYTES``, measured before; beyond that words are exchanged.
Places of matches are running sums over the lengths of gaps and matches, made by doubling, so a text with very many of them takes little longer.
The patterns start only where a match may start and never go back, which keeps long runs of one class of characters linear; they match the same.

Defined results: a null text counts as an empty one and has no spans. Rows are judged one by one: null and repeated ids do no harm, and rows
that repeat id and text have the same spans. Terms don't overlap base spans. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lower_ascii, written

#: Kinds of base spans, in order (fixed values).
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pass over its matches.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Four numbers of at most 255.
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: A term: what stands between ASCII punctuation, white space and control characters.
BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
TERM = f"[^{BETWEEN}]+"
#: Terms of fewer characters, or of digits alone, are not looked at.
LEAST_CHARS = 3
WINDOW = 8
LEAST_WINDOWS = 3
GENERALISE_AT, REMOVE_AT = 0.9, 0.95
BROADCAST_BYTES = 32 << 20
KEY = ["id", "hash", "chars"]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Array of ``op`` over all elements up to each; ``values`` has to be bound."""
    widths = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda w: w < F.size(values))
    return F.aggregate(widths, values, lambda so_far, w: F.transform(so_far, lambda y, i: F.when(i >= w, op(y, F.get(so_far, i - w))).otherwise(y)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the sum of digits, every second one from the right doubled, is a multiple of ten."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d < 5, 2 * d).otherwise(2 * d - 9)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return _let(_digits(value), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _same_value(kind: str, value: Column) -> Column:
    """How an entity is written for comparison."""
    return lower_ascii(value) if kind == "email" else value if kind == "ip" else _digits(value)


def matches(text: Column, pattern: Column, extra: Callable[[Column, Column, Column], list[Column]]) -> Column:
    """``start, end, ...`` of the leftmost non-overlapping matches, in code points; ``extra`` makes further fields of match, gap before and gap after."""
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"))

    def placed(p: Column) -> Column:
        sizes = F.zip_with(p.found, F.slice(p.gaps, 1, F.size(p.found)), lambda m, g: F.char_length(m) + F.char_length(g))

        def spans(ends: Column) -> Column:
            return F.transform(p.found, lambda m, i: F.struct((F.get(ends, i) - F.char_length(m)).alias("start"), F.get(ends, i).alias("end"), *extra(m, F.get(p.gaps, i), F.get(p.gaps, i + 1))))

        return _let(sizes, lambda s: _let(running(s, lambda x, y: x + y), spans))

    return _let(parts, placed)


def base_spans(text: Column, kind: str, window: int = WINDOW) -> Column:
    """``start, end, value, before, after`` of a kind's spans; ``before`` and ``after`` hold the words around, without other personal data."""

    def around(gap: Column, words: int) -> Column:
        near = F.substring_index(F.regexp_replace(gap, r"[\x20\x09-\x0D]+", " "), " ", words)
        for other in KINDS:
            near = F.regexp_replace(near, PATTERNS[other], " ")
        return near

    def extra(match: Column, before: Column, after: Column) -> list[Column]:
        return [match.alias("value"), before.alias("before"), after.alias("after")]

    def described(s: Column) -> Column:
        return F.struct(s.start.alias("start"), s.end.alias("end"), _same_value(kind, s.value).alias("value"), around(s.before, -window - 1).alias("before"), around(s.after, window + 1).alias("after"))

    found = F.transform(F.filter(matches(text, F.lit(PATTERNS[kind]), extra), lambda s: _valid(kind, s.value)), described)
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    return F.when(text.rlike(HINTS[kind]), found).otherwise(none)


def entity_table(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``id, hash, chars`` and the base spans by kind, of every row."""
    return docs.select("id", F.xxhash64("text").alias("hash"), F.char_length("text").alias("chars"), *[base_spans(F.col("text"), kind, window).alias(kind) for kind in KINDS])


def _terms_of(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda t: (F.char_length(t) >= LEAST_CHARS) & t.rlike("[^0-9]"))


def _entities(kind: str) -> Column:
    """Kind and value of each of a kind's spans, as one string."""
    return F.transform(kind, lambda s: F.concat(F.lit(kind), F.lit("\0"), s.value))


def evidence(table: DataFrame, least_windows: int = LEAST_WINDOWS) -> DataFrame:
    """``kind, value, term, n_pair, n_entity``: documents with the entity, and those with the term in one of its windows."""
    nul = F.lit("\0")

    def pairs(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.concat(F.lit(kind), nul, s.value).alias("entity"), F.xxhash64(s.before, s.after).alias("window"), F.array_distinct(F.concat(_terms_of(s.before), _terms_of(s.after))).alias("terms")))

    def written_out(c: Column) -> Column:
        return F.transform(c.terms, lambda t: F.concat(c.entity, nul, t))

    some = table.filter(" or ".join(f"size({kind}) > 0" for kind in KINDS))
    per_document = some.select(F.explode(F.array_distinct(F.flatten(F.transform(F.concat(*map(pairs, KINDS)), written_out)))).alias("pair"))
    n_pair = per_document.groupBy("pair").agg(F.count(F.lit(1)).alias("n_pair"))
    seen = some.select(F.explode(F.concat(*map(pairs, KINDS))).alias("c")).select("c.entity", "c.window", F.explode("c.terms").alias("term"))
    supported = seen.groupBy(F.concat("entity", nul, "term").alias("pair")).agg(F.count_distinct("window").alias("windows")).filter(F.col("windows") >= least_windows).select("pair")
    n_entity = some.select(F.explode(F.array_distinct(F.concat(*map(_entities, KINDS)))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    cut = F.split("pair", "\0", -1)
    found = n_pair.join(supported, "pair").select(cut[0].alias("kind"), cut[1].alias("value"), cut[2].alias("term"), "n_pair")
    return found.withColumn("entity", F.concat("kind", nul, "value")).join(n_entity, "entity").select("kind", "value", "term", "n_pair", "n_entity")


def _side(df: DataFrame, text: Column) -> DataFrame:
    """Broadcast if what it holds, measured, is within the bound."""
    size = df.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _words(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(*columns, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))).alias("term"))


def disclosing_pairs(docs: DataFrame, table: DataFrame, least_windows: int = LEAST_WINDOWS, generalise_at: float = GENERALISE_AT) -> DataFrame:
    """``entity, term, disclosure``: terms that disclose at least ``generalise_at`` of an entity's information."""
    pairs = written(evidence(table, least_windows), "evidence")
    n_term = _words(docs).filter(F.char_length("term") >= LEAST_CHARS).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    n = F.lit(float(table.count()))
    gained, own = F.log(n * F.col("n_pair") / (F.col("n_entity") * F.col("n_term").cast("double"))), F.log(n / F.col("n_entity"))
    share = F.when(own > 0, F.round(gained / own, 9)).otherwise(0.0)
    met = pairs.join(n_term, "term").select(F.concat("kind", F.lit("\0"), "value").alias("entity"), "term", share.alias("disclosure"))
    return met.filter(F.col("disclosure") >= generalise_at)


def _same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.hash") == F.col(f"{b}.hash")) & (F.col(f"{a}.chars") == F.col(f"{b}.chars"))


def _found_terms(docs: DataFrame, table: DataFrame, pairs: DataFrame, everywhere: bool) -> DataFrame:
    """``id, hash, chars, term, disclosure`` of the terms to be treated in each document."""
    terms = pairs.groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    key = ["id", F.xxhash64("text").alias("hash"), F.char_length("text").alias("chars")]
    hits = _words(docs, *key).join(_side(terms, F.col("term")), "term")
    if everywhere:
        return hits.select(*KEY, "term", "disclosure")
    told = written(hits.drop("disclosure").distinct(), "hits").join(pairs, "term").alias("h")
    held = table.select(*KEY, F.explode(F.array_distinct(F.concat(*map(_entities, KINDS)))).alias("entity")).distinct().alias("e")
    met = told.join(held, _same_row("h", "e") & (F.col("h.entity") == F.col("e.entity")))
    return met.groupBy("h.id", "h.hash", "h.chars", "h.term").agg(F.max("h.disclosure").alias("disclosure"))


def _clear_of(added: Column, base: Column) -> Column:
    """The ``added`` spans that overlap none of ``base``; both have start and end, and neither need be sorted."""
    far = F.lit(2147483647)

    def filtered(every: Column) -> Column:
        ends = F.transform(every, lambda x: F.when(x.added == 0, x.end).otherwise(0))
        nexts = F.transform(F.reverse(every), lambda x: F.when(x.added == 0, x.start).otherwise(far))

        def kept(e: Column, s: Column) -> Column:
            marked = F.transform(every, lambda x, i: F.when((x.added == 1) & (F.get(e, i) <= x.start) & (F.get(s, F.size(every) - 1 - i) >= x.end), F.struct(x.start.alias("start"), x.end.alias("end"))))
            return F.filter(marked, lambda x: x.isNotNull())

        return _let(ends, lambda v: _let(running(v, F.greatest), lambda e: _let(nexts, lambda w: _let(running(w, F.least), lambda s: kept(e, s)))))

    def tagged(spans: Column, k: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x.start.alias("start"), F.lit(k).alias("added"), x.end.alias("end")))

    return _let(F.array_sort(F.concat(tagged(base, 0), tagged(added, 1))), filtered)


def _places(text: Column, terms: Column) -> Column:
    """``start, end`` of the terms where they stand as whole terms."""
    pattern = F.concat(F.lit(f"(?<![^{BETWEEN}])(?:"), F.array_join(terms, "|"), F.lit(f")(?![^{BETWEEN}])"))
    return F.when(F.size(terms) > 0, matches(text, pattern, lambda *_: [])).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def disclosures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, least_windows: int = LEAST_WINDOWS, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT, everywhere: bool = False) -> DataFrame:
    """``id, hash, chars`` of every row, an array of ``start, end`` for each kind, and ``generalise`` and ``remove``, those of the terms."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = written(entity_table(texts, window), "entities")
    pairs = written(disclosing_pairs(texts, table, least_windows, generalise_at), "terms")
    remove = F.col("disclosure") >= remove_at
    hits = _found_terms(texts, table, pairs, everywhere).groupBy(*KEY)
    chosen = written(hits.agg(F.collect_set(F.when(~remove, F.col("term"))).alias("general"), F.collect_set(F.when(remove, F.col("term"))).alias("gone")), "chosen")
    held = _side(chosen, F.array_join(F.concat("general", "gone"), " ")).alias("h")
    met = texts.select("*", F.xxhash64("text").alias("hash"), F.char_length("text").alias("chars")).alias("t").join(held, _same_row("t", "h"))
    placed = met.select("t.id", "t.hash", "t.chars", _places(F.col("text"), F.col("general")).alias("generalise"), _places(F.col("text"), F.col("gone")).alias("remove")).dropDuplicates(KEY).alias("p")
    joined = table.alias("e").join(placed, _same_row("e", "p"), "left")
    spans = {kind: F.transform(f"e.{kind}", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))) for kind in KINDS}
    base = F.concat(*spans.values())
    added = [F.when(F.size(f"p.{name}") > 0, _clear_of(F.col(f"p.{name}"), base)).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias(name) for name in ("generalise", "remove")]
    return joined.select(F.col("e.id").alias(id_col), "e.hash", "e.chars", *[c.alias(k) for k, c in spans.items()], *added)


def listed(*kinds: str) -> Column:
    """``kind:start:end`` of the spans in the named columns, in their order, comma-joined."""

    def lines(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s.start, s.end))

    return F.array_join(F.concat(*map(lines, kinds)), ",")


def sanitised(text: Column) -> Column:
    """``text`` with the spans of the columns of :func:`disclosures` replaced: base spans by their kind, generalised terms by their shape, removed ones by
    nothing. Spans that overlap become one. Takes time in proportion to the text for each span."""

    def general(s: Column) -> Column:
        term = F.substring(text, s.start + 1, s.end - s.start)
        return F.when(term.rlike("[0-9]"), "[CODE]").when(term.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")

    def replaced(kind: str) -> Column:
        def by(s: Column) -> Column:
            return general(s) if kind == "generalise" else F.lit("" if kind == "remove" else f"[{kind.upper()}]")

        return F.transform(kind, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), by(s).alias("by")))

    spans = F.array_sort(F.concat(*map(replaced, (*KINDS, "generalise", "remove"))))

    def put(every: Column, ends: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            past = F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
            return F.when(s.start >= past, F.concat(F.substring(text, past + 1, s.start - past), s.by)).otherwise("")

        tail = F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0))
        return F.concat(F.array_join(F.transform(every, one), ""), F.substring(text, tail + 1, F.char_length(text)))

    full = F.coalesce(text, F.lit(""))
    made = _let(spans, lambda every: _let(F.transform(every, lambda s: s.end), lambda e: _let(running(e, F.greatest), lambda ends: put(every, ends))))
    return F.when(F.size(spans) > 0, made).otherwise(full)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``id, text`` of every row, the text sanitised. Rows that repeat id and text stay as many as they are. Texts are exchanged once, unless few rows have spans."""
    found = disclosures(docs, id_col, text_col, **parameters)
    some = written(found.filter(" or ".join(f"size({k}) > 0" for k in (*KINDS, "generalise", "remove"))).dropDuplicates([id_col, "hash", "chars"]), "spans").alias("s")
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t")
    same = F.col(f"t.{id_col}").eqNullSafe(F.col(f"s.{id_col}")) & (F.xxhash64("t.text") == F.col("s.hash")) & (F.char_length("t.text") == F.col("s.chars"))
    return texts.join(some, same, "left").select(F.col(f"t.{id_col}"), F.when(F.col("s.hash").isNull(), F.col("t.text")).otherwise(sanitised(F.col("t.text"))).alias("text"))
