"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Texts become tokens in which numbers, names (capitalised words inside a sentence) and units (after a number) are slots with
a typed placeholder. Windows of the placeholders and words are hash-joined with those of the benchmark: a question that
was asked anew with other values has the same windows. Then the slots are checked: along one alignment (diagonal) of
document and item, each value of the item must stand for one value of the document. Diagonals whose slots disagree don't
count; a document is contaminated by an item if enough of the item's windows remain: three in ten, which is some fourteen
tokens in a row for an item of thirty.

A window of more slots than words says too little as a template and is joined with its values instead. Items of fewer than
``least`` tokens (any short phrase would do) are found where they fill a line, or the whole text. In scripts that don't part
their words a token is a character.

Only window hashes are joined, never texts; the benchmark's windows are counted and broadcast up to ``broadcast_windows``,
joined by shuffle beyond. The texts of documents are looked at again only where an item with slots was hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedmesh.plans.storage import saved

UNITS = (
    "%", "percent", "kg", "g", "mg", "lb", "lbs", "oz", "tons?", "km", "cm", "mm", "m", "miles?", "met(?:er|re)s?", "inch(?:es)?", "feet", "foot", "ft", "yards?", "hours?", "hrs?", "h", "min(?:ute)?s?",
    "sec(?:ond)?s?", "s", "ms", "days?", "weeks?", "months?", "years?", "dollars?", "euros?", "cents?", "pounds?", "usd", "eur", "lit(?:er|re)s?", "l", "ml", "gallons?", "mph", "kph", "degrees?", "c", "f",
    "watts?", "kw", "kwh", "volts?", "v", "hz", "gb", "mb", "kb",
)
#: Slots are put between \x01 (names) or \x03 (units) and \x02 before tokens are taken.
UNIT_AFTER = rf"(\d)\s*\b(?i:({'|'.join(UNITS[1:])}))\b|(\d)\s*(%)"
#: The repeated groups are possessive, as the JVM's matcher takes a stack frame for each repeat of any other group; nothing
#: follows them, so they match the same. The SQL has neither such groups nor frames.
NAME = r"([\p{Ll}\p{N},;:]['\"(]?[ \t]+)(\p{Lu}[\p{Ll}\p{M}][\p{L}\p{M}]*(?:[ \t]+\p{Lu}[\p{Ll}\p{M}][\p{L}\p{M}]*)*+)"
#: Thai, Lao, Myanmar, Khmer, kana and Chinese characters.
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3041}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"
TOKEN = rf"[\x01\x03][^\x02]*\x02|\d+(?:[.,]\d+)*+|[\p{{L}}\p{{M}}&&[^{UNSPACED}]]+|[\p{{L}}\p{{M}}&&[{UNSPACED}]]"
#: The same after each unspaced character has been set apart.
_SQL_TOKEN = r"[\x01\x03][^\x02]*\x02|\d+(?:[.,]\d+)*|[\p{L}\p{M}]+"
_BETWEEN = r"[^\p{L}\p{M}\p{N}]+"


def tokens(text: Column, names: bool = True) -> Column:
    """Lower-case tokens; slots of names and units keep their marks. names: whether names are slots."""
    plain = F.translate(text, "\x01\x02\x03", "   ")
    units = F.regexp_replace(plain, UNIT_AFTER, "$1$3 \x03$2$4\x02")
    marked = F.regexp_replace(units, NAME, "$1\x01$2\x02") if names else units
    return F.regexp_extract_all(F.lower(marked), F.lit(TOKEN), F.lit(0))


def placeholder(token: Column) -> Column:
    """The slot's type, or null for a word."""
    first = F.substring(token, 1, 1)
    return F.when(first == "\x01", "<name>").when(first == "\x03", "<unit>").when((first >= "0") & (first <= "9"), "<num>")


def template(own: Column) -> Column:
    return F.transform(own, lambda t: F.coalesce(placeholder(t), t))


def values(own: Column) -> Column:
    """Tokens without the marks: a word that looks like a name in one place and not in another is the same value."""
    return F.transform(own, lambda t: F.translate(t, "\x01\x02\x03", ""))


def windows(own: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` tokens, in order; none for shorter texts."""
    n = F.size(own)
    made = F.transform(F.sequence(F.lit(1), n - F.lit(size - 1)), lambda i: F.xxhash64(F.lit(size), F.slice(own, i, size)))
    return F.when(n >= size, made).otherwise(F.array().cast("array<bigint>"))


def value_windows(own: Column, size: int) -> Column:
    """Structs (pos, h) of the windows with more slots than words, which are hashed with their values. From the places of
    the slots, so that a text pays for its slots only."""
    need = size // 2 + 1
    slots = F.array_compact(F.transform(own, lambda t, i: F.when(placeholder(t).isNotNull(), i)))
    span = lambda k: F.struct(
        F.greatest(F.lit(0), F.element_at(slots, k + need) - F.lit(size - 1)).alias("a"), F.least(F.element_at(slots, k + 1), F.size(own) - F.lit(size)).alias("b")
    )
    spans = F.filter(F.transform(F.sequence(F.lit(0), F.size(slots) - F.lit(need)), span), lambda x: x["a"] <= x["b"])
    places = F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["a"], x["b"]))))
    made = F.transform(places, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(size), F.lit("="), values(F.slice(own, i + 1, size))).alias("h")))
    return F.when((F.size(own) >= size) & (F.size(slots) >= need), made).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))


def line_keys(text: Column) -> Column:
    """Hashes of the words of each line, and of the whole text."""
    bare = lambda x: F.trim(F.regexp_replace(F.lower(x), _BETWEEN, " "))
    return F.transform(F.filter(F.array_distinct(F.transform(F.array_append(F.split(text, "\n"), text), bare)), lambda x: x != ""), lambda x: F.xxhash64(x))


def short_items(benchmark: DataFrame, least: int) -> DataFrame:
    """(item_id, h) of the items of fewer than ``least`` tokens."""
    few = F.size(tokens(F.col("text"), False))
    whole = F.element_at(line_keys(F.col("text")), -1)
    return benchmark.where("text is not null").where((few > 0) & (few < least)).select("item_id", whole.alias("h")).distinct()


def item_tokens(benchmark: DataFrame) -> DataFrame:
    """(item_id, form, t): form 0 has names as slots; form 1, of items with names, as words, for texts that have lost their
    capitals (or are all capitals)."""
    own = benchmark.where("text is not null").select("item_id", tokens(F.col("text")).alias("t"), tokens(F.col("text"), False).alias("plain"))
    forms = F.when(F.exists("t", lambda x: x.startswith("\x01")), F.array("t", "plain")).otherwise(F.array("t"))
    return own.select("item_id", F.posexplode(forms).alias("form", "t"))


def item_windows(benchmark: DataFrame, size: int, least: int) -> DataFrame:
    """(item_id, form, ipos, size, by_value, h): the item's windows, with their values if less than half are words. Items of
    fewer than ``size`` tokens are one window; those of fewer than ``least`` have none (see short_items)."""
    own = item_tokens(benchmark).withColumn("c", template(F.col("t"))).withColumn("size", F.least(F.lit(size), F.size("t")))
    own = own.where(F.col("size") >= least).withColumn("ipos", F.explode(F.expr("sequence(0, size(t) - size)")))
    part = lambda x: F.slice(x, F.col("ipos") + 1, F.col("size"))
    by_value = F.size(F.filter(part("c"), lambda x: ~x.startswith("<"))) * 2 < F.col("size")
    h = F.when(F.col("by_value"), F.xxhash64(F.col("size"), F.lit("="), values(part("t")))).otherwise(F.xxhash64(F.col("size"), part("c")))
    return own.withColumn("by_value", by_value).select("item_id", "form", "ipos", "size", "by_value", h.alias("h")).distinct()


def _hits(docs: DataFrame, items: DataFrame, sizes: list[int], by_value: list[int], small: bool) -> DataFrame:
    """(doc_id, pos, item_id, form, ipos, size). sizes: of the items' windows; by_value: of those with their values."""
    own = docs.select("doc_id", tokens(F.col("text")).alias("own"))
    templates = own.select("doc_id", template(F.col("own")).alias("t"), *["own"] * bool(by_value))
    if len(sizes) == 1 and not by_value:
        placed = templates.select("doc_id", F.posexplode(windows(F.col("t"), sizes[0])).alias("pos", "h"))
    else:
        every = [F.transform(windows(F.col("t"), s), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for s in sizes]
        placed = templates.select("doc_id", F.inline(F.concat(*every, *[value_windows(F.col("own"), s) for s in by_value])))
    return placed.join(F.broadcast(items) if small else items, "h").select("doc_id", "pos", "item_id", "form", "ipos", "size")


def _slots(own: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """(keys, place, kind, value) of the slots of token arrays t."""
    each = own.select(*keys, F.posexplode("t").alias(place, value))
    return each.withColumn("kind", placeholder(F.col(value))).where("kind is not null")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = 8, least: int = 5, cover: float = 0.3, consistency: float = 0.8, broadcast_windows: int = 2_000_000, broadcast_ids: int = 500_000
) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, slots, agreeing, reparameterised): one row for each document and benchmark
    item of which at least ``cover`` of the windows are in the document with consistent slots.

    docs (doc_id, text), benchmark (item_id, text). slots: placeholders compared, agreeing: those that have the most
    frequent counterpart of their item value, reparameterised: whether a slot's value differs. An item of fewer than
    ``least`` tokens counts as one window, without slots; one without a token is never found. Null or short texts have no
    windows; rows with a null id take no part. Rows of one doc_id count as one document, rows of one item_id as one item.
    Empty tables: no rows. Extra columns are left out.
    """
    docs = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    benchmark = benchmark.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text"))
    items = saved(item_windows(benchmark, size, least))
    sizes = [r["size"] for r in items.select("size").distinct().orderBy("size").collect()] or [size]  # at most ``size`` numbers
    by_value = [r["size"] for r in items.where("by_value").select("size").distinct().orderBy("size").collect()]
    hits = saved(_hits(docs, items, sizes, by_value, items.count() <= broadcast_windows))
    totals = items.groupBy("item_id", "form").agg(F.countDistinct("ipos").alias("item_windows"))
    # in whole thousandths, so that no rounding decides
    enough = F.col("windows") * 1000 >= F.col("item_windows") * round(cover * 1000)
    both = ["doc_id", "item_id", "form"]
    counted = lambda d: d.groupBy(*both).agg(F.countDistinct("ipos").alias("windows")).join(totals, ["item_id", "form"]).where(enough)
    likely = hits.join(counted(hits).select(*both), both, "left_semi").withColumn("diagonal", F.col("pos") - F.col("ipos"))
    # slots of the items along each diagonal that was hit
    item_slots = _slots(item_tokens(benchmark), ["item_id", "form"], "iplace", "item_value").distinct()
    covered = likely.select(*both, "diagonal", F.explode(F.expr("sequence(ipos, ipos + size - 1)")).alias("iplace")).distinct()
    asked = saved(covered.join(item_slots, ["item_id", "form", "iplace"]).withColumn("place", (F.col("iplace") + F.col("diagonal")).cast("int")))
    ids = asked.select("doc_id").distinct()
    n = ids.count()
    if n:
        again = docs.join(F.broadcast(ids) if n <= broadcast_ids else ids, "doc_id", "left_semi")
        doc_slots = _slots(again.select("doc_id", tokens(F.col("text")).alias("t")), ["doc_id"], "place", "value").distinct()
        pairs = asked.join(doc_slots, ["doc_id", "place", "kind"])
        one = [*both, "diagonal"]
        by_value = pairs.groupBy(*one, "kind", "item_value", "value").count()
        by_item_value = by_value.groupBy(*one, "kind", "item_value").agg(
            F.sum("count").alias("slots"), F.max("count").alias("agreeing"), F.max((F.col("value") != F.col("item_value")).cast("int")).alias("changed")
        )
        judged = by_item_value.groupBy(*one).agg(F.sum("slots").alias("slots"), F.sum("agreeing").alias("agreeing"), F.max("changed").alias("changed"))
        likely = likely.join(judged, one, "left").where(F.col("slots").isNull() | (F.col("agreeing") >= F.col("slots") * consistency))
        along = likely.select(*one, "slots", "agreeing", "changed").distinct().groupBy(*both).agg(
            F.coalesce(F.sum("slots"), F.lit(0)).alias("slots"), F.coalesce(F.sum("agreeing"), F.lit(0)).alias("agreeing"), (F.coalesce(F.max("changed"), F.lit(0)) == 1).alias("reparameterised")
        )
        found = counted(likely).join(along, both)
    else:
        found = counted(likely).withColumns({"slots": F.lit(0).cast("long"), "agreeing": F.lit(0).cast("long"), "reparameterised": F.lit(False)})
    # of an item's two forms the one with the larger share
    fields = ["windows", "item_windows", "slots", "agreeing", "reparameterised"]
    best = F.max_by(F.struct(*fields), F.struct(F.col("windows") / F.col("item_windows"), -F.col("form"))).alias("best")
    found = found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")
    short = saved(short_items(benchmark, least))
    n = short.count()
    if not n:
        return found
    lines = docs.where("text is not null").select("doc_id", F.explode(line_keys(F.col("text"))).alias("h")).join(F.broadcast(short) if n <= broadcast_windows else short, "h")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return found.unionByName(lines.select("doc_id", "item_id").distinct().withColumns(dict(zip(fields, (one, one, none, none, F.lit(False)), strict=True))))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_ids: int = 500_000, **options) -> DataFrame:
    """docs without the documents that hold a benchmark item; rows with a null doc_id stay. The ids to drop are counted, and
    broadcast if they are few, so that texts aren't shuffled."""
    bad = saved(contaminated(docs, benchmark, broadcast_ids=broadcast_ids, **options).select("doc_id").distinct())
    few = bad.count() <= broadcast_ids
    return docs.join(F.broadcast(bad) if few else bad, "doc_id", "left_anti").select(*docs.columns)


def _sql_tokens(text: str, with_names: bool = True) -> str:
    plain = f"translate({text}, chr(1) || chr(2) || chr(3), '   ')"
    q = lambda pattern: pattern.replace("'", "''").replace(")*+", ")*")
    units = f"regexp_replace({plain}, '{q(UNIT_AFTER)}', '\\1\\3 ' || chr(3) || '\\2\\4' || chr(2), 'g')"
    names = f"regexp_replace({units}, '{q(NAME)}', '\\1' || chr(1) || '\\2' || chr(2), 'g')"
    return f"regexp_extract_all(regexp_replace(lower({names if with_names else units}), '([{UNSPACED}])', ' \\1 ', 'g'), '{q(_SQL_TOKEN)}')"


def _sql_bare(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '{_BETWEEN}', ' ', 'g'))"


_KIND = "CASE WHEN {t}[1] = chr(1) THEN '<name>' WHEN {t}[1] = chr(3) THEN '<unit>' WHEN {t}[1] BETWEEN '0' AND '9' THEN '<num>' END"
_PART = """CASE WHEN 2 * len(list_filter(t[{pos} + 1 : {pos} + {size}], lambda x: NOT starts_with(x, '<'))) >= {size} THEN t[{pos} + 1 : {pos} + {size}]
      ELSE list_prepend('=', list_transform(own[{pos} + 1 : {pos} + {size}], lambda x: translate(x, chr(1) || chr(2) || chr(3), ''))) END"""
_T = f"list_transform(own, lambda t: coalesce({_KIND.format(t='t')}, t))"
SQL = f"""
WITH doc AS (
  SELECT doc_id, own, {_T} AS t FROM (SELECT doc_id, {_sql_tokens('text')} AS own FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
item AS (
  SELECT item_id, form, own, {_T} AS t, least(8, len(own)) AS size
  FROM (SELECT item_id, 0 AS form, {_sql_tokens('text')} AS own FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
        UNION ALL
        SELECT item_id, 1, {_sql_tokens('text', False)} FROM benchmark
        WHERE item_id IS NOT NULL AND len(list_filter({_sql_tokens('text')}, lambda t: t[1] = chr(1))) > 0)),
item_window AS (
  SELECT DISTINCT item_id, form, ipos, size, {_PART.format(pos='ipos', size='size')} AS part
  FROM (SELECT *, unnest(range(0, len(t) - size + 1)) AS ipos FROM item WHERE size >= 5)),
doc_window AS (
  SELECT doc_id, pos, s.size, {_PART.format(pos='pos', size='s.size')} AS part
  FROM (SELECT doc_id, t, own, size, unnest(range(0, len(t) - size + 1)) AS pos FROM doc CROSS JOIN (SELECT DISTINCT size FROM item_window)) s),
hit AS (
  SELECT doc_id, pos, item_id, form, ipos, size FROM doc_window JOIN item_window USING (size, part)),
total AS (SELECT item_id, form, count(DISTINCT ipos) AS item_windows FROM item_window GROUP BY ALL),
first_pass AS (
  SELECT doc_id, item_id, form FROM hit JOIN total USING (item_id, form) GROUP BY doc_id, item_id, form, item_windows
  HAVING count(DISTINCT ipos) >= item_windows * 0.3),
likely AS (SELECT hit.*, pos - ipos AS diagonal FROM hit SEMI JOIN first_pass USING (doc_id, item_id, form)),
item_slot AS (
  SELECT DISTINCT item_id, form, p - 1 AS iplace, own[p] AS item_value, {_KIND.format(t='own[p]')} AS kind
  FROM (SELECT item_id, form, own, unnest(range(1, len(own) + 1)) AS p FROM item)),
doc_slot AS (
  SELECT DISTINCT doc_id, p - 1 AS place, own[p] AS value, {_KIND.format(t='own[p]')} AS kind
  FROM (SELECT doc_id, own, unnest(range(1, len(own) + 1)) AS p FROM doc SEMI JOIN first_pass USING (doc_id))),
covered AS (
  SELECT DISTINCT doc_id, item_id, form, diagonal, unnest(range(ipos, ipos + size)) AS iplace FROM likely),
compared AS (
  SELECT doc_id, item_id, form, diagonal, kind, item_value, value, count(*) AS n
  FROM covered JOIN (SELECT * FROM item_slot WHERE kind IS NOT NULL) USING (item_id, form, iplace)
  JOIN (SELECT doc_id, place AS dplace, value, kind FROM doc_slot WHERE kind IS NOT NULL) USING (doc_id, kind)
  WHERE dplace = iplace + diagonal GROUP BY ALL),
judged AS (
  SELECT doc_id, item_id, form, diagonal, sum(slots) AS slots, sum(agreeing) AS agreeing, bool_or(changed) AS changed FROM (
    SELECT doc_id, item_id, form, diagonal, kind, item_value, sum(n) AS slots, max(n) AS agreeing, bool_or(value <> item_value) AS changed
    FROM compared GROUP BY ALL) GROUP BY ALL),
kept AS (
  SELECT likely.*, slots, agreeing, changed FROM likely LEFT JOIN judged USING (doc_id, item_id, form, diagonal)
  WHERE slots IS NULL OR agreeing >= slots * 0.8),
along AS (
  SELECT doc_id, item_id, form, coalesce(sum(slots), 0) AS slots, coalesce(sum(agreeing), 0) AS agreeing, coalesce(bool_or(changed), false) AS reparameterised
  FROM (SELECT DISTINCT doc_id, item_id, form, diagonal, slots, agreeing, changed FROM kept) GROUP BY ALL)
SELECT doc_id, item_id, windows, item_windows, slots, agreeing, reparameterised FROM (
  SELECT doc_id, item_id, CAST(count(DISTINCT ipos) AS BIGINT) AS windows, CAST(item_windows AS BIGINT) AS item_windows,
         CAST(along.slots AS BIGINT) AS slots, CAST(along.agreeing AS BIGINT) AS agreeing, reparameterised,
         row_number() OVER (PARTITION BY doc_id, item_id ORDER BY count(DISTINCT ipos) / item_windows DESC, form) AS place
  FROM kept JOIN total USING (item_id, form) JOIN along USING (doc_id, item_id, form)
  GROUP BY doc_id, item_id, form, item_windows, along.slots, along.agreeing, reparameterised
  HAVING count(DISTINCT ipos) >= item_windows * 0.3)
WHERE place = 1
UNION ALL
SELECT DISTINCT doc_id, item_id, 1, 1, 0, 0, false FROM (
  SELECT doc_id, unnest(list_transform(list_append(string_split(text, chr(10)), text), lambda x: {_sql_bare('x')})) AS k FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
JOIN (SELECT item_id, {_sql_bare('text')} AS k FROM benchmark WHERE item_id IS NOT NULL AND len({_sql_tokens('text', False)}) BETWEEN 1 AND 4) USING (k)
"""
