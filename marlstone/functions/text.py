"""Text functions on columns.

Python's ``\\s``, ``\\d`` and ``\\w`` are Unicode classes, so patterns carry ``(?U)``
where that shows.  Null texts count as empty unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that carry no content, and headings that are not sections.
DECORATIVE_LINE = r"(?iU)^(大集中\s*ERP\s*项目|第\s*\d+\s*页\s*共\s*\d+\s*页)$"
IGNORED_HEADING = r"^(资料说明与适用范围|目录|版本信息|谢谢|感谢聆听|大集中ERP项目|大集中ERP.*业务组)$"
TOC_NOISE = r"完成该步骤|角色名称|菜单路径|详细操作描述|^\d+(?:\.\d+)*[.、]?操作步骤$"
PAGE_NUMBERS_ONLY = r"(?U)^[\d\s.,，、:：;；\-—_()/（）]+$"
FIRST_TITLE = "资料说明与适用范围"
PROJECT_TYPES = ("投资项目", "其他费用项目", "数信项目", "科技项目", "费用项目")
FAQ_LABELS = ("问题描述", "问题原因", "解决办法")
TOPIC_CUTS = (r"(?i)^DJZ_MDG_用户操作手册[_-]?", r"(?iU)^MDG[.\d]+[\s_-]*", r"(?iU)[_-]V\d+(?:\.\d+)*.*$", r"(?U)^\d+[.、\s]+", r"(?U)\s*\(\d+\)$")
DOCUMENT_KINDS = "(业务流程|操作手册|用户手册|流程)$"
FAQ_HEADERS = "(核算|资金|司库|内部交易)常见问题"
_LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(c: Column | str) -> Column:
    """Array of lines, as universal line breaks cut them."""
    return F.split(text_of(c), _LINE_BREAK)


def tokens(c: Column | str) -> Column:
    """Array of search tokens, repeats kept: Latin words and codes in small letters, then bigrams of each Han run (a lone character as it is)."""
    text = text_of(c)
    latin = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+(?:[_-][a-z0-9]+)*)"), 1)
    runs = F.regexp_extract_all(text, F.lit("([一-鿿]+)"), 1)
    pairs = F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: r.substr(i, F.lit(2)))))
    return F.concat(latin, F.flatten(pairs))


def token_count(c: Column | str) -> Column:
    """Number of search tokens, without making them."""
    text = text_of(c)
    runs = F.regexp_extract_all(text, F.lit("([一-鿿]+)"), 1)
    pairs = F.aggregate(runs, F.lit(0), lambda n, r: n + F.greatest(F.length(r) - 1, F.lit(1)))
    return F.regexp_count(F.lower(text), F.lit("[a-z0-9]+(?:[_-][a-z0-9]+)*")) + pairs


def clean_lines(c: Column | str) -> Column:
    """Struct: ``text``, the stripped lines that are neither blank nor decorative, and ``removed``, the decorative ones."""
    stripped = F.filter(F.transform(lines(c), strip), lambda x: x != "")
    return F.struct(
        F.array_join(F.filter(stripped, lambda x: ~x.rlike(DECORATIVE_LINE)), "\n").alias("text"),
        F.filter(stripped, lambda x: x.rlike(DECORATIVE_LINE)).alias("removed"),
    )


def xml_text(c: Column | str) -> Column:
    """Characters that XML forbids become U+FFFD."""
    return F.regexp_replace(text_of(c), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uD800-\\uDFFF\\uFFFE\\uFFFF]", "�")


def compact(c: Column | str) -> Column:
    """Without any white space, and without colons at the ends."""
    return F.regexp_replace(F.regexp_replace(text_of(c), r"(?U)\s+", ""), "^[：:]+|[：:]+$", "")


def file_stem(name: Column) -> Column:
    """Last path component without its suffix; a leading dot is no suffix."""
    base = F.regexp_extract(name, "([^/]*)/*$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def filename_topic(c: Column | str) -> Column:
    """Topic that a file name tells: stem without system prefix, module code, version tail, number and copy mark."""
    out = file_stem(text_of(c))
    for pattern in TOPIC_CUTS:
        out = F.regexp_replace(out, pattern, "")
    return compact(out)


def short_alias(c: Column) -> Column:
    """Name without the kind of document at its end; null where fewer than three characters are left."""
    short = F.regexp_replace(c, DOCUMENT_KINDS, "")
    return F.when(F.length(short) >= 3, short)


def aliases(names: Column, topic: Column) -> Column:
    """Distinct names in order: given ones, the topic, then the short forms of both."""
    known = F.concat(names, F.array(topic))
    return F.array_distinct(F.concat(known, F.array_compact(F.transform(known, short_alias))))


def page_number_only(c: Column | str) -> Column:
    return strip(text_of(c)).rlike(PAGE_NUMBERS_ONLY)


def ignored_heading(c: Column) -> Column:
    """Headings that name no section: fixed ones, and those of digits and punctuation alone."""
    t = compact(c)
    return (t == "") | t.rlike(IGNORED_HEADING) | t.rlike(r"(?U)^[\d\W]+$")


def heading_number(c: Column) -> Column:
    """Dotted number at the start of a heading; empty if there is none."""
    return F.regexp_extract(c, r"(?U)^(\d+(?:\.\d+)*)(?:[.、\s]|(?=[^\d.]))", 1)


def toc_heading(title: Column, level: Column) -> Column:
    """Whether an outline entry starts a section."""
    return (level <= 2) & ~F.regexp_replace(title, r"(?U)\s+", "").rlike(TOC_NOISE)


def parse_pages(spec: Column, count: Column) -> Column:
    """Sorted distinct page numbers of a list such as ``3-5,5,8``; raises for ranges that are reversed or outside 1..count."""
    spans = F.transform(F.split(spec, ","), lambda p: F.split(F.trim(p), "-"))
    low = lambda s: s[0].cast("int")
    high = lambda s: F.element_at(s, -1).cast("int")
    bad = F.exists(spans, lambda s: (F.size(s) > 2) | (low(s) < 1) | (low(s) > high(s)) | (high(s) > count))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(low(s), F.greatest(low(s), high(s)))))))
    return F.when(bad, F.raise_error(F.concat(F.lit("invalid page range "), spec, F.lit("; page count="), count.cast("string")))).otherwise(pages)


def faq_fields(c: Column | str) -> Column:
    """Map label -> value of a labelled question text, whatever the labels' order; the last of equal labels counts.

    Soft line breaks inside a sentence are closed; those after a full stop or
    colon and before numbered items stay.
    """
    text = F.regexp_replace(text_of(c), FAQ_HEADERS, "")
    label = "(" + "|".join(FAQ_LABELS) + r")(?U)\s*[：:]"
    mark = "\x01"
    parts = F.slice(F.split(F.regexp_replace(text, label, mark + "$1" + "\x02"), mark), 2, 1_000_000)
    value = lambda p: strip(F.regexp_replace(F.substring_index(p, "\x02", -1), r"(?<![。；;：:])\n(?!(?U)\s*\d+[、.])", ""))
    entries = F.transform(parts, lambda p: F.struct(F.substring_index(p, "\x02", 1).alias("key"), value(p).alias("value")))
    last = lambda name: F.try_element_at(F.filter(entries, lambda e: e["key"] == name), F.lit(-1))
    found = F.array_compact(F.array(*[last(name) for name in FAQ_LABELS]))
    return F.map_from_entries(found)


def markdown_images(c: Column | str) -> Column:
    """Targets of the images in a Markdown text."""
    return F.regexp_extract_all(text_of(c), F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), 1)


def contains_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def document_version(name: Column) -> Column:
    """Version in a file name, or ``unknown``."""
    found = F.regexp_extract(name, r"(?i)[_-](V\d+(?:\.\d+)*)", 1)
    return F.when(found == "", "unknown").otherwise(found)


def project_type(path: Column) -> Column:
    """First project keyword in a path, or ``not_applicable``."""
    out = F.lit("not_applicable")
    for word in reversed(PROJECT_TYPES):
        out = F.when(path.contains(word), word).otherwise(out)
    return out


def page_label(pages: Column) -> Column:
    """Pages as runs: ``1–3、5``; pages between runs are never implied."""
    ordered = F.array_sort(F.array_distinct(pages))
    starts = F.filter(ordered, lambda p: ~F.array_contains(ordered, p - 1))
    ends = F.filter(ordered, lambda p: ~F.array_contains(ordered, p + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("–"), b.cast("string"))))
    return F.array_join(runs, "、")


def window_offsets(length: Column, size: int = 300, overlap: int = 60) -> Column:
    """Offsets of sliding windows: the last is the first that reaches the end; one at 0 for an empty text."""
    if not 0 <= overlap < size <= 350:
        raise ValueError("need 0 <= overlap < size <= 350")
    stride = size - overlap
    last = F.greatest(F.ceil((length - size) / stride), F.lit(0)).cast("int") * stride
    return F.sequence(F.lit(0), last, F.lit(stride))


def passage_prefix(topic: Column, title: Column) -> Column:
    """Heading repeated in each window: topic and title, cut to 65 and 85 characters."""
    return F.concat(F.substring(topic, 1, 65), F.lit(" / "), F.substring(title, 1, 85), F.lit("\n"))


def human_bytes(n: Column) -> Column:
    """Size with one decimal in the largest unit below 1024."""
    shown = lambda power, unit: F.concat(F.bround(n / 1024.0**power, 1).cast("decimal(20,1)").cast("string"), F.lit(f" {unit}"))
    out = shown(4, "TiB")
    for power, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB")):
        out = F.when(n < 1024 ** (power + 1), shown(power, unit)).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def fingerprint(*columns: Column | str) -> Column:
    """SHA-256 of the values as JSON in the given order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def source_identity(path: Column, upload_name: Column, relative: Column) -> Column:
    """Key of a source across scans: its own path, or the upload's name and relative path; small letters, forward slashes."""
    return F.when(upload_name.isNotNull(), F.concat(F.lit("upload:"), F.lower(upload_name), F.lit(":"), F.lower(F.replace(relative, F.lit("\\"), F.lit("/"))))).otherwise(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))))


def safe_relative(path: Column) -> Column:
    """Relative path with forward slashes, or null where it is absolute, climbs out, or is no PDF."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = F.startswith(p, F.lit("/")) | p.rlike("^[A-Za-z]:") | F.array_contains(F.split(p, "/"), "..") | ~F.lower(p).endswith(".pdf")
    return F.when(~bad, p)


def region_id(box: Column) -> Column:
    """Eight hex digits of a box (edges rounded to two places, half to even)."""
    return F.substring(F.sha2(F.to_json(F.transform(box, lambda x: F.bround(x, 2))), 256), 1, 8)


def image_id(source_id: Column, page: Column, box: Column | None = None) -> Column:
    """Id of a picture of a page by its box, or of the whole page."""
    if box is None:
        return F.format_string("%s-p%04d-page", source_id, page)
    return F.format_string("%s-p%04d-%s", source_id, page, region_id(box))


def with_defaults(given: Column, defaults: Column) -> Column:
    """Map of ``defaults`` where ``given`` has no value under a key, else of ``given``."""
    own = F.coalesce(given, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(own, k)), own)


def metadata_map(entries: Column) -> Column:
    """Map of an array of structs (name, value); the last of equal names counts."""
    names = F.array_distinct(F.transform(entries, lambda e: e["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["name"] == n), -1)["value"]))


def holds_all(inner: Column, outer: Column) -> Column:
    """Whether every element of ``inner`` is in ``outer``."""
    return F.size(F.array_except(inner, outer)) == 0
