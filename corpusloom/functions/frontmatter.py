"""Headers of Markdown files between lines of three dashes: readers and writer as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import WS, chain, trim

#: What a header stands between.
MARK = "---"
#: Begins a pattern over the lines of a header, which only a line feed ends: Java's own lines end at U+0085, U+2028 and others too.
LINES = "(?md)"


def split_header(text: Column) -> Column:
    """(header, body); without a header the header is null and the body the whole text."""
    # the header ends at the first such line, so nothing after it is matched to find it
    end = F.when(F.startswith(text, F.lit(MARK + "\n")), F.locate("\n" + MARK, text, len(MARK) + 2))
    whole, after = end > 0, end + len(MARK) + 1
    rest = F.when(F.substr(text, after, F.lit(1)) == "\n", after + 1).otherwise(after)
    return F.struct(F.when(whole, F.substr(text, F.lit(len(MARK) + 2), end - len(MARK) - 2)).alias("header"), F.when(whole, F.substr(text, rest)).otherwise(text).alias("body"))


def unquote(x: Column, compat: bool = False, exact: bool = False) -> Column:
    """Without one quote at each end and, unless compat, with escaped quotes and backslashes as they were; with exact also line breaks."""
    bare = chain(trim(x), (r"\A[\"']", ""), (r"[\"']\z", ""))
    return bare if compat else unescape(bare, exact)


def scalar(header: Column, key: str, compat: bool = False, exact: bool = False) -> Column:
    """A scalar field; null where there is none and, unless exact, where it is blank."""
    raw = F.regexp_extract(header, rf"{LINES}^{key}:[ \t]*(.*)$", 1)
    value = unquote(raw, compat, exact)
    return F.when(header.rlike(rf"{LINES}^{key}:"), value if exact else F.nullif(value, F.lit("")))


def items(header: Column, key: str, compat: bool = False, exact: bool = False) -> Column:
    """A list field, of lines or in brackets; empty where there is none."""
    block = F.regexp_extract(header, rf"{LINES}^{key}:[ \t]*\n((?:[ \t]*-[ \t]+.*(?:\n|\z))+)", 1)
    inline = F.regexp_extract(header, rf"{LINES}^{key}:[ \t]*\[(.*)\][ \t]*$", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[ \t]*-[ \t]+"))
    from_block = F.transform(lines, lambda x: unquote(F.regexp_replace(x, r"^[ \t]*-[ \t]+", ""), compat, exact))
    from_inline = F.filter(F.transform(F.split(inline, ","), lambda x: unquote(x, compat, exact)), lambda x: x != "")
    return F.when(F.size(lines) > 0, from_block).otherwise(from_inline)


def tags(base: Column, given: Column, compat: bool = False) -> Column:
    """The collection's tag before the given ones; with compat also where it is among them."""
    out = F.concat(F.array(base), F.coalesce(given, F.array().cast("array<string>")))
    return out if compat else F.array_distinct(out)


def escape(x: Column, exact: bool = False) -> Column:
    """As a value stands between quotes: trimmed, with spaces for line breaks; with exact nothing of it is lost."""
    x = F.replace(F.coalesce(x, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    x = F.replace(F.replace(x, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n" if exact else " "))
    return x if exact else trim(x)


def unescape(x: Column, exact: bool = False) -> Column:
    """What ``escape`` was given; line breaks with exact only."""
    x = F.regexp_replace(x, r"(?<!\\)((?:\\\\)*)\\n", "$1\n") if exact else x
    return F.regexp_replace(x, r'\\(["\\])', "$1")


def render(fields: list[tuple[str, Column, str]], exact: bool = False) -> Column:
    """A header of (name, value, kind): kind is string, number or list. Null fields are left out, an empty list is [].

    With exact, readers that are exact as well give the values as they were, without it trimmed and in one line.
    """

    def line(name: str, value: Column, kind: str) -> Column:
        if kind == "list":
            listed = F.concat(F.lit(f"{name}:\n"), F.array_join(F.transform(value, lambda x: F.concat(F.lit('  - "'), escape(x, exact), F.lit('"'))), "\n"))
            return F.when(value.isNotNull(), F.when(F.size(value) == 0, F.lit(f"{name}: []")).otherwise(listed))
        shown = value.cast("string") if kind == "number" else F.concat(F.lit('"'), escape(value, exact), F.lit('"'))
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), shown))

    return F.concat_ws("\n", F.lit("---"), *(line(*f) for f in fields), F.lit("---"))


def set_number(text: Column, key: str, value: Column) -> Column:
    """The text with a number of its header replaced."""
    return F.when(text.rlike(rf"(?m)^{key}:.*$"), F.concat(F.regexp_extract(text, rf"\A([\s\S]*?)(?m:^{key}:.*$)", 1), F.lit(f"{key}: "), value.cast("string"), F.regexp_extract(text, rf"\A[\s\S]*?(?m:^{key}:.*$)([\s\S]*)\z", 1))).otherwise(text)


def preamble(body: Column, opening: str) -> Column:
    """The block quote that opens a body, with its rule, if its first line matches; else an empty string."""
    return F.regexp_extract(body, rf"\A{WS}*((?:> \*{opening}[^\n]*\n)(?:(?:>[^\n]*|[ \t]*)\n)*?(?:---[ \t]*(?:\n|\z)))", 1)


def _last(header: Column, pattern: str) -> Column:
    """What the last match captures that isn't blank, trimmed; null where there is none."""
    found = F.transform(F.regexp_extract_all(header, F.lit(pattern), F.lit(1)), trim)
    return F.try_element_at(F.filter(found, lambda x: x != ""), F.lit(-1))


def search_scalar(header: Column, key: str) -> Column:
    """As the search reads a field: the value may stand on the next line, one quote at each end goes; null where blank."""
    return F.nullif(chain(_last(header, rf"{LINES}^{key}:\s*(.*)$"), (r"\A[\"']", ""), (r"[\"']\z", "")), F.lit(""))


def map_scalar(header: Column, key: str) -> Column:
    """As the map reads a field: within its line, all quotes at the ends go; null where the line has no value."""
    return chain(_last(header, rf"{LINES}^{key}:[ \t]*(.*)$"), (r"\A[\"']+", ""), (r"[\"']+\z", ""))


def map_items(header: Column, key: str) -> Column:
    """As the map reads a list: of lines only; empty where there is none."""
    block = F.regexp_extract(header, rf"{LINES}^{key}:[ \t]*\n((?:[ \t]*-[ \t].*(?:\n|\z))+)", 1)
    found = F.regexp_extract_all(block, F.lit(rf"{LINES}^[ \t]*-[ \t](.+)$"), F.lit(1))
    return F.transform(found, lambda x: chain(trim(x), (r"\A[\"']+", ""), (r"[\"']+\z", "")))


def raw_header(text: Column) -> Column:
    """(header, body): the header as it stands with both lines of dashes, the body without the line break after it.

    Without a closing line the header is null and the body the whole text.
    """
    end = F.locate("\n---", text, 4)
    whole = F.startswith(text, F.lit("---")) & (end > 0)
    body = F.regexp_replace(F.substr(text, end + 4), r"\A\n", "")
    return F.struct(F.when(whole, F.substr(text, F.lit(1), end + 3)).alias("header"), F.when(whole, body).otherwise(text).alias("body"))


def listed(header: Column, key: str, compat: bool = False) -> Column:
    """A list field that may also be one string of values between commas."""
    parts = F.split(F.regexp_replace(F.coalesce(scalar(header, key, compat), F.lit("")), r"\A\[|\]\z", ""), ",")
    values = F.filter(F.transform(parts, lambda x: unquote(x, compat)), lambda x: x != "")
    found = items(header, key, compat)
    return F.when(F.size(found) > 0, found).otherwise(values)


def synthesised(slug: Column, title: Column, post_date: Column, url: Column, collection: str, author: str, base_url: str) -> Column:
    """A header for a post that has none, from what its source says of it; all of that may be null."""
    none = F.lit("")
    return render([
        ("title", F.coalesce(F.nullif(title, none), slug), "string"), ("collection", F.lit(collection), "string"), ("kind", F.lit("post"), "string"),
        ("order", F.lit(0), "number"), ("date", F.nullif(F.substring(post_date, 1, 10), none), "string"), ("author", F.lit(author), "string"),
        ("original_url", F.coalesce(F.nullif(url, none), F.concat(F.lit(base_url), slug)), "string"), ("excerpt", none, "string"),
        ("word_count", F.lit(0), "number"), ("tags", F.array(F.lit(collection)), "list"), ("related", F.array().cast("array<string>"), "list"),
    ])
