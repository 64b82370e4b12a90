"""Texts of HTML pages: which count, how they group, which languages they have, how a translation is split back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lingora.functions.lang import detect

# Elements whose text is never translated.
IGNORED = ["script", "style", "noscript", "svg", "canvas", "code", "pre", "kbd", "samp", "var", "math", "template", "iframe", "object", "embed", "applet"]
# Elements that end a group of texts.
BLOCKS = [
    "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "table", "section",
    "article", "aside", "header", "footer", "main", "nav", "blockquote", "figure", "figcaption", "br", "hr", "form", "fieldset", "legend", "details", "summary",
]
# Attributes with text, by element; then names and properties of meta elements.
ATTRIBUTES = {"*": ["title"], "input": ["placeholder"], "textarea": ["placeholder"], "img": ["alt"], "area": ["alt"], "abbr": ["title"], "a": ["title"], "button": ["title"]}
META_NAMES, META_PROPERTIES = ["keywords", "description", "sharetitle"], ["og:title", "og:description", "og:site_name"]

# Elements without content; names of characters, the ampersand last.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00A0", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•", "hellip": "…", "mdash": "—", "ndash": "–",
    "laquo": "«", "raquo": "»", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "times": "×", "euro": "€", "deg": "°", "sect": "§", "amp": "&",
}

#: Comments, whole scripts and style sheets, tags with quoted values, declarations, and what is between them.
TOKEN = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|</?[a-z][^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>|<[!?][^>]*>"
    r"|[^<]+(?:<[^a-z/!?<][^<]*)*|<[^a-z/!?<][^<]*|<"
)
_ATTRIBUTE = r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"


def unescaped(text: Column) -> Column:
    """Numbered characters and the named ones of ENTITIES as themselves."""
    code = lambda p: F.regexp_extract(p, "^(?i)(x[0-9a-f]{1,5}|[0-9]{1,6});", 1)
    digits = lambda p: F.when(F.lower(code(p)).startswith("x"), F.substr(code(p), F.lit(2))).otherwise(F.conv(code(p), 10, 16))
    letter = lambda p: F.concat(F.decode(F.unhex(F.lpad(digits(p), 8, "0")), "UTF-32"), F.substr(p, F.length(code(p)) + 2))
    parts = F.transform(F.split(text, "&#", -1), lambda p, i: F.when(i == 0, p).when(code(p) == "", F.concat(F.lit("&#"), p)).otherwise(letter(p)))
    numbered = F.when(F.contains(text, F.lit("&#")), F.array_join(parts, "")).otherwise(text)
    named = F.array(*[F.struct(F.lit(f"&{k};").alias("name"), F.lit(v).alias("letter")) for k, v in ENTITIES.items()])
    return F.when(~F.contains(text, F.lit("&")), text).otherwise(F.aggregate(named, numbered, lambda t, e: F.replace(t, e["name"], e["letter"])))


def tokens(pages: DataFrame) -> DataFrame:
    """(page_id, at, token, kind, name): the markup of each page in order; kind is open, close, raw, other or text, names are in lower case."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(TOKEN), 0)).alias("at", "token"))
    t = F.col("token")
    raw = F.lower(F.substr(t, F.lit(1), F.lit(8))).rlike(r"^<(script|style)\b") & t.rlike(r"(?i)</(script|style)\s*>\z")
    kind = F.when(raw, "raw").when(t.rlike("^</[A-Za-z]"), "close").when(t.rlike("^<[A-Za-z]") & t.endswith(">"), "open").when(t.rlike("^<[!?/]"), "other").otherwise("text")
    return rows.select("page_id", "at", "token", kind.alias("kind")).withColumn("name", F.when(F.col("kind").isin("open", "close", "raw"), F.lower(F.regexp_extract(t, r"^</?([^\s/>]+)", 1))))


def _last(name: str, values: Column) -> Column:
    """The value of an attribute, the last one that is given; empty without a value, null without the attribute."""
    return F.try_element_at(F.filter(values, lambda v: v["name"] == name), F.lit(-1))["value"]


def attributes(token: Column) -> Column:
    """array<struct<name, value>> of a tag."""
    inside = F.regexp_replace(token, r"^<[^\s/>]+|/?>\z", "")
    names, values = (F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), k) for k in (1, 2))
    return F.zip_with(names, values, lambda n, v: F.struct(F.lower(n).alias("name"), unescaped(F.regexp_replace(v, "^[\"']|[\"']\\z", "")).alias("value")))


def nested(pages: DataFrame, ignored_classes: list[str] | None = None, ignored_ids: list[str] | None = None) -> DataFrame:
    """tokens() with `off` (ignored subtrees around it), `block` (the nearest block element), `edges` (tags of blocks so far), `serial` and `given` (attributes).

    A closing tag belongs to the nearest element of its name that is open: both have the same depth among the tags of
    the name, closers without an opener left out. An element that is never closed ends with the one around it, one that
    is closed after that has ended keeps its own closer, also if an outer element of its name is left without one. Then the
    beginnings and ends of ignored elements and of blocks are summed over the page, and a text's block is the last
    one that began at the text's own depth.
    """
    in_page = Window.partitionBy("page_id").orderBy("at")
    upto = in_page.rowsBetween(Window.unboundedPreceding, 0)
    is_open, is_close = F.col("kind") == "open", F.col("kind") == "close"
    given = tokens(pages).withColumn("given", F.when(is_open, attributes(F.col("token"))))
    rows = given.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id")
    void = F.col("name").isin(VOID) | F.col("token").endswith("/>")
    classes = F.split(F.trim(F.coalesce(_last("class", F.col("given")), F.lit(""))), r"\s+")
    marked_off = F.col("name").isin(IGNORED) | F.exists("given", lambda a: a["name"] == "data-no-translate") | (_last("translate", F.col("given")) == "no")
    marked_off = marked_off | F.arrays_overlap(classes, F.array(*map(F.lit, ignored_classes or []), F.lit(None).cast("string"))) | _last("id", F.col("given")).isin(ignored_ids or [])
    begun = F.count_if(F.col("kind").isin("open", "raw")).over(upto)
    rows = rows.withColumns({"begins": is_open & ~void, "self_off": is_open & F.coalesce(marked_off, F.lit(False)), "is_block": F.coalesce(F.col("name").isin(BLOCKS), F.lit(False)), "serial": begun})

    step = F.when(F.col("begins"), 1).when(is_close, -1).otherwise(0)
    named = Window.partitionBy("page_id", "name").orderBy("at")
    rows = rows.withColumn("sum", F.sum(step).over(named.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("low", F.least(F.lit(0), F.min("sum").over(named.rowsBetween(Window.unboundedPreceding, 0))))
    stray = is_close & (F.col("low") < F.coalesce(F.lag("low").over(named), F.lit(0)))
    depth = F.col("sum") - F.col("low")
    level = F.when(F.col("begins"), depth).when(is_close & ~F.col("stray"), depth + 1)
    rows = rows.withColumn("stray", stray).withColumn("level", level)
    after = F.lead("at").over(Window.partitionBy("page_id", "name", "level").orderBy("at"))
    rows = rows.withColumn("end", F.when(F.col("begins"), after))

    paired = F.when(F.col("end").isNotNull(), 1).when(is_close & ~F.col("stray"), -1).otherwise(0)
    rows = rows.withColumn("around", F.sum(paired).over(upto))
    outer = F.last("end", ignorenulls=True).over(Window.partitionBy("page_id", F.when(F.col("begins"), F.col("around"))).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", F.when(F.col("begins"), F.coalesce("end", F.when(F.col("around") > 0, outer))))

    counts = F.col("begins") & (F.col("is_block") | F.col("self_off"))
    change = lambda sign: F.struct(F.when(F.lit(sign < 0), F.col("end")).otherwise(F.col("at")).alias("at"), F.lit(sign).alias("phase"))
    both = F.explode(F.when(counts & F.col("end").isNotNull(), F.array(change(1), change(-1))).otherwise(F.array(change(1))))
    rows = rows.withColumn("when", both)
    begins, ends = F.col("when.phase") == 1, F.col("when.phase") == -1
    ordered = Window.partitionBy("page_id").orderBy("when.at", "when.phase").rowsBetween(Window.unboundedPreceding, 0)
    sign = lambda flag: F.sum(F.when(F.col("begins") & F.col(flag), F.col("when.phase")).otherwise(0)).over(ordered)
    rows = rows.withColumns({
        "off": sign("self_off"), "depth": sign("is_block"),
        "edges": F.count_if(begins & F.col("is_block") & (is_open | is_close)).over(ordered),
    })
    inner = Window.partitionBy("page_id", "depth").orderBy("when.at", "when.phase").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(begins & F.col("begins") & F.col("is_block"), F.concat_ws("#", "name", "serial")), ignorenulls=True).over(inner)
    rows = rows.withColumn("block", F.when(F.col("depth") > 0, own).otherwise("body#0"))
    return rows.where(~ends).select("page_id", "at", "kind", "name", "token", "given", "self_off", "off", "block", "edges", "serial")


def nodes(pages: DataFrame, rules: dict[str, list[str]] | None = None, ignored_classes: list[str] | None = None, ignored_ids: list[str] | None = None) -> DataFrame:
    """(page_id, pos, kind, name, block, boundary, text): texts that count with their blocks, and texts in attributes and meta elements.

    rules: attributes with text for each element or `*`. Pages are rows of markup from the first step to the last.
    """
    rules = ATTRIBUTES if rules is None else rules
    rows = nested(pages, ignored_classes, ignored_ids)
    before = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blank = r"^[\s\x1C-\x1F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]*\z"
    rows = rows.where(((F.col("kind") == "text") | (F.col("kind") == "open")) & (F.col("off") == 0) & ~F.col("self_off"))
    rows = rows.withColumn("text", F.when(F.col("kind") == "text", unescaped(F.col("token")))).withColumn("kept", (F.col("kind") == "text") & ~F.col("text").rlike(blank))
    edge = F.col("edges") > F.coalesce(F.last(F.when(F.col("kept"), F.col("edges")), ignorenulls=True).over(before), F.lit(-1))
    node = lambda kind, name, text: F.struct(kind.alias("kind"), name.alias("name"), text.alias("text"))
    by_tag = F.create_map(*[x for tag, names in rules.items() for x in (F.lit(tag), F.array(*map(F.lit, names)))]) if rules else F.lit(None).cast("map<string,array<string>>")
    none = F.array().cast("array<string>")
    wanted = F.array_distinct(F.concat(F.coalesce(F.try_element_at(by_tag, F.lit("*")), none), F.coalesce(F.try_element_at(by_tag, F.col("name")), none)))
    value = lambda name: F.try_element_at(F.filter("given", lambda g: g["name"] == name), F.lit(-1))["value"]
    found = F.transform(wanted, lambda w: node(F.lit("attribute"), w, value(w)))
    meta_name = F.when(value("name").isin(META_NAMES), value("name")).when(value("property").isin(META_PROPERTIES), F.coalesce(F.nullif(value("name"), F.lit("")), value("property")))
    meta = F.when((F.col("name") == "meta") & meta_name.isNotNull(), F.array(node(F.lit("meta"), meta_name, value("content")))).otherwise(F.array().cast("array<struct<kind:string,name:string,text:string>>"))
    given = F.filter(F.concat(found, meta), lambda a: F.trim(F.coalesce(a["text"], F.lit(""))) != "")
    all_ = F.when(F.col("kept"), F.array(node(F.lit("text"), F.lit(""), F.col("text")))).when(F.col("kind") == "open", given)
    block = F.when(F.col("kind") == "text", F.col("block")).otherwise(F.concat_ws("#", "name", "serial"))
    boundary = F.when(F.col("kind") == "text", edge.cast("int")).otherwise(1)
    each = rows.select("page_id", "at", block.alias("block"), boundary.alias("boundary"), F.posexplode(all_).alias("nth", "a"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("at", "nth")) - 1
    return each.select("page_id", place.alias("pos"), "a.kind", "a.name", "block", "boundary", "a.text")


def text_groups(found: DataFrame) -> DataFrame:
    """(page_id, group_idx, block, text, fragments): neighbours in one block with no block element between them."""
    in_page = Window.partitionBy("page_id").orderBy("pos")
    new = ((F.col("boundary") == 1) | (F.lag("block").over(in_page) != F.col("block"))).cast("int")
    islands = found.where("kind = 'text'").withColumn("group_idx", F.sum(F.coalesce(new, F.lit(1))).over(in_page))
    rows = islands.groupBy("page_id", "group_idx").agg(F.first("block").alias("block"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("nodes"))
    begins = F.aggregate(F.col("nodes"), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(n["text"]))))
    fragments = F.zip_with("nodes", F.slice(begins, F.lit(1), F.size("nodes")), lambda n, b: F.struct(n["text"].alias("text"), b.alias("offset")))
    return rows.select("page_id", "group_idx", "block", F.array_join(F.transform("nodes", lambda n: n["text"]), "").alias("text"), fragments.alias("fragments"))


def visible_first(groups: DataFrame, page: list[str], order: str, visible: str = "visible") -> DataFrame:
    """groups with place: those in view before all others of a page, else in their order."""
    seen = F.coalesce(F.col(visible), F.lit(False))
    return groups.withColumn("place", F.row_number().over(Window.partitionBy(*page).orderBy(F.desc(seen), order)) - 1)


def languages(groups: DataFrame, target: str) -> DataFrame:
    """Groups with their language, without those in the target's."""
    return groups.withColumn("lang", detect(F.col("text"))["lang"]).where(F.col("lang") != target)


def batches(groups: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """Batch numbers by a size that falls with the mean length: 20 under 20 characters, 10 under 100, else 5."""
    whole = Window.partitionBy(*partition)
    mean = F.avg(F.length("text")).over(whole)
    size = F.when(mean < 20, 20).when(mean < 100, 10).otherwise(5)
    place = F.row_number().over(whole.orderBy(*order))
    return groups.withColumn("batch_size", size).withColumn("batch", F.floor((place - 1) / F.col("batch_size")).cast("int"))


def marked(fragments: Column) -> Column:
    """Texts of fragments, each followed by its numbered marker."""
    return F.array_join(F.transform(fragments, lambda f, i: F.concat(f["text"], F.lit("\0TM"), i.cast("string"), F.lit("\0"))), "")


def split_back(translated: Column, fragments: Column) -> Column:
    """A translated group as texts of its fragments: at the markers, or else in proportion to their lengths."""
    n = F.size(fragments)
    parts = F.split(translated, "\0TM[0-9]+\0", -1)
    numbers = F.regexp_extract_all(translated, F.lit("\0TM([0-9]+)\0"), 1)
    whole = numbers == F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("string"))
    at_markers = F.transform(F.slice(parts, F.lit(1), n), lambda p, i: F.when(i == n - 1, F.concat(p, F.element_at(parts, -1))).otherwise(p))
    bare = F.regexp_replace(translated, "\0TM[0-9]+\0", "")
    total = F.aggregate(fragments, F.lit(0), lambda acc, f: acc + F.length(f["text"]))
    cuts = F.transform(fragments, lambda f: F.round(F.length(f["text"]) / total * F.length(bare)).cast("int"))
    begin = lambda i: F.aggregate(F.slice(cuts, F.lit(1), i), F.lit(0), lambda acc, c: acc + c)
    shares = F.transform(cuts, lambda c, i: F.when(i == n - 1, F.substr(bare, begin(i) + 1)).otherwise(F.substr(bare, begin(i) + 1, c)))
    return F.when(whole, at_markers).otherwise(shares)
