"""Pictures of HTML: slots, candidate URLs, their rank, identity, extension and place; Columns throughout."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import decode_entities

#: Hosts of media, as a pattern, and the one of them that always answers; parameters of a site.
MEDIA_HOSTS = r"cdn\.example\.(?:com|net)/image|media\.s3\.example\.com"
FIRST_HOST = r"cdn\.example\."


def attribute(attrs: Column, name: str) -> Column:
    """Decoded value of a quoted attribute, an empty string where there is none."""
    return decode_entities(F.regexp_extract(attrs, rf'(?i)(?<![A-Za-z0-9_]){name}\s*=\s*"([^"]*)"', 1))


def img_attributes(html: Column) -> Column:
    """Attribute text of each img, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<img(?![A-Za-z0-9_])([^>]*)>"), F.lit(1))


def candidates(attrs: Column, links: Column | None = None) -> Column:
    """Distinct web addresses of a picture: its src, the two of its JSON attribute (malformed JSON has none), and of
    the links round it the first that holds the second of these, plain or encoded, or its last part."""
    data = attribute(attrs, "data-attrs")
    own = F.get_json_object(data, "$.src")
    urls = [attribute(attrs, "src"), F.get_json_object(data, "$.srcNoWatermark"), own]
    if links is not None:
        last = F.regexp_extract(own, r"([^/]+)\z", 1)
        holds = lambda u: F.contains(u, own) | F.contains(u, F.url_encode(own)) | ((last != "") & F.contains(u, last))
        urls.append(F.get(F.filter(links, lambda u: F.coalesce((own != "") & holds(u), F.lit(False))), F.lit(0)))
    return F.array_distinct(F.filter(F.array(*urls), lambda u: F.coalesce(u.rlike(r"(?i)\Ahttps?://"), F.lit(False))))


def rank_of(url: Column, first_host: str = FIRST_HOST) -> Column:
    """The less, the better: the first host before others, then those that cap no width."""
    return F.when(url.rlike(f"(?i){first_host}"), 0).otherwise(10) + F.when(url.rlike(r"(?i)[?/,]w_[0-9]+"), 1).otherwise(0)


def ranked(urls: Column, hosts: str = MEDIA_HOSTS, first_host: str = FIRST_HOST) -> Column:
    """Media addresses by rank, ties in their order."""
    marked = F.transform(urls, lambda u, i: F.struct(rank_of(u, first_host).alias("rank"), i.alias("i"), u.alias("url")))
    return F.transform(F.array_sort(F.filter(marked, lambda m: m["url"].rlike(f"(?i){hosts}"))), lambda m: m["url"])


def identity(url: Column, hosts: str = MEDIA_HOSTS) -> Column:
    """What equal pictures share: the file under /public/images/, else a name that starts with a UUID, else the last part on a media host, else the address without its query."""
    path = F.coalesce(F.try_url_decode(url), url)
    under = F.regexp_extract(path, r"(?i)/public/images/([^/?#\s\"']+)", 1)
    named = F.regexp_extract(path, r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}_[^/?#\s\"']+)", 1)
    bare = F.regexp_replace(url, r"\?[\s\S]*\z", "")
    last = F.when(url.rlike(f"(?i){hosts}"), F.regexp_extract(bare, r"([^/]+)\z", 1)).otherwise("")
    return F.coalesce(*(F.lower(F.nullif(x, F.lit(""))) for x in (under, named, last)), bare)


def extension(url: Column, content_type: Column) -> Column:
    """By the content type, else by the address, else jpg."""
    kind = F.regexp_extract(F.lower(F.coalesce(content_type, F.lit(""))), "(png|jpe?g|webp|gif|svg)", 1)
    path = F.coalesce(F.try_url_decode(url), url, F.lit(""))
    named = F.lower(F.regexp_extract(path, r"(?i)\.(png|jpe?g|webp|gif|svg)(?:\?|&|!|\z)", 1))
    return F.replace(F.coalesce(F.nullif(kind, F.lit("")), F.nullif(named, F.lit("")), F.lit("jpg")), F.lit("jpeg"), F.lit("jpg"))


def media_path(slug: Column, n: Column, ext: Column, folder: str = "/media") -> Column:
    """Place of the n-th picture, from 1."""
    return F.concat_ws("/", F.lit(folder), slug, F.concat(n.cast("string"), F.lit("."), ext))


#: Characters before and after a picture in which the links that may lead to it are looked for.
BEFORE, AFTER = 800, 2500
IMG = re.compile(r"<img(?![A-Za-z0-9_])([^>]*)>", re.I)
CAPTION = re.compile(r"<figcaption(?![A-Za-z0-9_])[^>]*>(.*?)</figcaption>", re.I | re.S)
LINK = re.compile(r"<a(?![A-Za-z0-9_])([^>]*)>", re.I)
FIGURE_TAG = re.compile(r"<(/?)figure(?![A-Za-z0-9_])[^>]*>", re.I)


def _link(attrs: str) -> str | None:
    kind, href = (re.search(rf'(?<![A-Za-z0-9_-]){name}\s*=\s*"([^"]*)"', attrs, re.I) for name in ("class", "href"))
    return href[1].replace("&amp;", "&") if href and kind and "image-link" in kind[1] else None


def slots_of(html: str) -> list[dict]:
    """attrs, links and caption of each img in order; a caption is that of the innermost figure open at the picture."""
    links = [(m.start(), _link(m[1])) for m in LINK.finditer(html)]
    links = [(at, u) for at, u in links if u]
    figures: list[tuple[int, int]] = []
    opened: list[int] = []
    for m in FIGURE_TAG.finditer(html):
        if not m[1]:
            opened.append(m.end())
        elif opened:
            figures.append((opened.pop(), m.start()))
    figures.sort()
    out, inside, k, lo, hi = [], [], 0, 0, 0
    for m in IMG.finditer(html):
        while k < len(figures) and figures[k][0] <= m.start():
            inside.append(figures[k])
            k += 1
        while inside and inside[-1][1] <= m.start():
            inside.pop()
        while lo < len(links) and links[lo][0] < m.start() - BEFORE:
            lo += 1
        hi = max(hi, lo)
        while hi < len(links) and links[hi][0] < m.end() + AFTER:
            hi += 1
        caption = CAPTION.search(html, *inside[-1]) if inside else None
        out.append({"attrs": m[1], "links": [u for _, u in links[lo:hi]], "caption": caption[1] if caption else ""})
    return out


def raw_slots(html: Column) -> Column:
    """Of each img: attribute text, image links near it, HTML of its figure's caption. Nesting isn't regular, hence Arrow."""

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda h: slots_of(h) if h else [])

    return F.pandas_udf(find, "array<struct<attrs string, links array<string>, caption string>>")(html)


def in_body(pages: DataFrame, key: str, html: str, hosts: str = MEDIA_HOSTS, first_host: str = FIRST_HOST) -> DataFrame:
    """(key, n, url, candidates, alt, caption): the pictures of media hosts in order, n from 1, each identity once.

    Null HTML has none. A row is a page; the pages' texts aren't shuffled.
    """
    found = F.transform("slots", lambda s: F.struct(candidates(s["attrs"], s["links"]).alias("all"), attribute(s["attrs"], "alt").alias("alt"), s["caption"].alias("caption")))
    ranks = F.transform(found, lambda s: F.struct(ranked(s["all"], hosts, first_host).alias("candidates"), s["alt"].alias("alt"), s["caption"].alias("caption")))
    kept = F.transform(F.filter(ranks, lambda s: F.size(s["candidates"]) > 0), lambda s: F.struct(s["candidates"][0].alias("url"), s["candidates"].alias("candidates"), s["alt"].alias("alt"), s["caption"].alias("caption"), identity(s["candidates"][0], hosts).alias("identity")))
    rows = pages.select(key, raw_slots(F.col(html)).alias("slots")).select(key, kept.alias("kept"))
    rows = rows.select(key, F.filter("kept", lambda s, i: F.array_position(F.transform("kept", lambda t: t["identity"]), s["identity"]) == i + 1).alias("kept"))
    return rows.select(key, F.posexplode("kept").alias("pos", "s")).select(key, (F.col("pos") + 1).alias("n"), "s.url", "s.candidates", "s.alt", "s.caption")


def stored_files(paths: DataFrame) -> DataFrame:
    """(slug, n, ext, path) of stored pictures, by paths like <slug>/<n>.<ext>; other files are left out."""
    pattern = r"(?i)(?:\A|/)([^/]+)/([1-9][0-9]{0,8})\.(png|jpe?g|webp|gif|svg)\z"
    part = lambda i: F.regexp_extract("path", pattern, i)
    return paths.where(F.col("path").rlike(pattern)).select(part(1).alias("slug"), part(2).cast("int").alias("n"), F.replace(F.lower(part(3)), F.lit("jpeg"), F.lit("jpg")).alias("ext"), "path")


def match_files(slots: DataFrame, files: DataFrame) -> DataFrame:
    """Slots (slug, n) with the stored file of that number, null where none is stored; of several the first by path."""
    one = files.groupBy("slug", "n").agg(F.min_by(F.struct("ext", "path"), "path").alias("f"))
    return slots.join(one, ["slug", "n"], "left").select(*(slots[c] for c in slots.columns), F.col("f.ext").alias("ext"), F.col("f.path").alias("path"))
