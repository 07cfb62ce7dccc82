"""Names, addresses of pages, excerpts and error texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.functions.values import ColumnOrName, _col

#: White space, the wider kinds included.
SPACE = r"[\s\p{Z}\x{FEFF}]"

#: Patterns of notes that editors leave in a cell, and of instructions that point elsewhere in a sheet.
EDITORIAL_MARKER = (
    r"(?i)(?:\*\*|\[\[|<<|\{\{)\s*(?:verify|todo|fixme|check|tbd|xxx|placeholder|confirm|review)\b"
    r"|\b(?:verify|todo|fixme|tbd|xxx)\s*(?:\*\*|\]\]|>>|\}\})"
)
INSTRUCTION = r"(?i)\bsee (?:that|this|the) (?:row|column|cell|tab|sheet|above|below)\b|\bsee (?:above|below)\b"
RENAMED = r"(?i)\bnow\b.+\bsee\b"

#: Cities looked for in an address, in this order.
CITIES = ("Denver", "Evergreen", "Estes Park", "Boulder", "Lakewood", "Littleton", "Arvada", "Golden", "Bailey")

#: The cities of the metropolitan area.
METRO_CITIES = (
    "denver",
    "aurora", "centennial", "littleton", "englewood", "greenwood village", "sheridan", "glendale", "cherry hills village",
    "columbine valley", "bow mar", "foxfield", "deer trail",
    "lakewood", "arvada", "wheat ridge", "golden", "edgewater", "morrison", "westminster", "ken caryl", "columbine",
    "thornton", "northglenn", "commerce city", "brighton", "federal heights", "bennett",
    "broomfield",
    "highlands ranch", "parker", "castle rock", "castle pines", "lone tree", "roxborough park", "the pinery",
    "idaho springs", "georgetown", "black hawk", "central city",
)


def collapsed(text: ColumnOrName) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), SPACE + "+", " "))


def slug(name: ColumnOrName, most: int = 80) -> Column:
    """Letters a-z, digits and hyphens; other marks vanish, spaces become hyphens."""
    kept = F.regexp_replace(F.lower(_col(name)), r"[^a-z0-9\s\p{Z}\x{FEFF}-]", "")
    joined = F.regexp_replace(F.regexp_replace(kept, SPACE + "+", "-"), "-+", "-")
    return F.substring(F.regexp_replace(joined, "^-|-$", ""), 1, most)


def dashed_slug(name: ColumnOrName, most: int | None = 60) -> Column:
    """Every run of other characters becomes one hyphen."""
    out = F.regexp_replace(F.regexp_replace(F.lower(_col(name)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.substring(out, 1, most) if most else out


def match_name(name: ColumnOrName) -> Column:
    """The form in which names are compared: & is "and", other marks are spaces."""
    plain = F.regexp_replace(F.replace(F.lower(_col(name)), F.lit("&"), F.lit(" and ")), r"[^a-z0-9\s\p{Z}\x{FEFF}]", " ")
    return collapsed(plain)


def stripped_name(name: ColumnOrName, collapse: bool = True) -> Column:
    """Marks are taken out rather than replaced by spaces."""
    plain = F.regexp_replace(F.lower(_col(name)), r"[^a-z0-9\s\p{Z}\x{FEFF}]", "")
    return collapsed(plain) if collapse else F.regexp_replace(plain, f"^{SPACE}+|{SPACE}+$", "")


def item_name(name: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(F.lower(_col(name)), "[^a-z0-9]+", " "))


def domain(url: ColumnOrName) -> Column:
    """Lower-case host without www.; null where the text is no URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(_col(url), F.lit("HOST"))), r"^www\.", "")


def raw_host(url: ColumnOrName) -> Column:
    """What stands between http(s):// and the next slash, as written, with port; without www. A text of
    another form comes back whole."""
    return F.regexp_replace(_col(url), r"(?s)^https?://(?:www\.)?([^/]+).*", "$1")


def domain_title(host: ColumnOrName) -> Column:
    """A host's first label as a title: hyphens, underscores and inner capitals part words."""
    label = F.regexp_replace(F.split(_col(host), r"\.")[0], "[-_]", " ")
    words = F.split(F.regexp_replace(label, "([a-z])([A-Z])", "$1 $2"), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def safe_url(url: ColumnOrName) -> Column:
    """The URL if it is http or https, else null."""
    return F.when(F.lower(F.try_parse_url(_col(url), F.lit("PROTOCOL"))).isin("http", "https"), _col(url))


def bigrams(name: ColumnOrName) -> Column:
    """The different pairs of neighbouring characters; none of a text under two."""
    name = _col(name)
    at = F.sequence(F.lit(1), F.length(name) - 1)
    pairs = F.array_distinct(F.transform(at, lambda i: F.substring(name, i, F.lit(2))))
    return F.when(F.length(name) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def trigrams(name: ColumnOrName) -> Column:
    """The different threes of characters of each word, with two spaces before it and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(_col(name)), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    threes = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(threes))


def dice(a: Column, b: Column) -> Column:
    """2 |a and b| / (|a| + |b|) of two sets, 0 if one of them is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * both / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(F.size(F.array_union(a, b)) > 0, both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def has_editorial_marker(text: ColumnOrName) -> Column:
    return F.coalesce(_col(text).rlike(EDITORIAL_MARKER), F.lit(False))


def is_artifact_name(name: ColumnOrName) -> Column:
    """True where a name is rather a note or an instruction that came along in an import."""
    name = _col(name)
    return has_editorial_marker(name) | F.coalesce(name.rlike(INSTRUCTION) | name.rlike(RENAMED), F.lit(False))


def city_of(address: ColumnOrName) -> Column:
    """What stands before ", CO", else the first known city that the address names, else null."""
    address = _col(address)
    before_state = F.regexp_extract(address, r"(?i),?\s*([A-Za-z\s]+),?\s*CO", 1)
    known = F.coalesce(*[F.when(address.contains(c), c) for c in CITIES])
    return F.when(address.rlike(r"(?i),?\s*([A-Za-z\s]+),?\s*CO"), F.trim(F.regexp_replace(before_state, r"^\s+|\s+$", ""))).otherwise(known)


def in_metro(city: ColumnOrName) -> Column:
    return collapsed(F.lower(F.coalesce(_col(city), F.lit("")))).isin(*METRO_CITIES)


def shown_name(proposed: ColumnOrName, fallback: ColumnOrName) -> Column:
    text = lambda c: F.nullif(F.trim(_col(c)), F.lit(""))
    return F.coalesce(text(proposed), text(fallback), F.lit("Unnamed camp"))


def value_summary(text: ColumnOrName, most: int = 500) -> Column:
    text = _col(text)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def excerpt_preview(text: ColumnOrName, most: int = 140) -> Column:
    """Null for an empty excerpt; a longer one is cut, with an ellipsis and no space before it."""
    text = F.nullif(_col(text), F.lit(""))
    cut = F.regexp_replace(F.substring(text, 1, most), SPACE + "+$", "")
    return F.when(F.length(text) > most, F.concat(cut, F.lit("…"))).otherwise(text)


def cut_at_word(text: ColumnOrName, most: int) -> Column:
    """At most so many characters and whole words only, then an ellipsis; dangling marks before it go."""
    clean = collapsed(text)
    head = F.substring(clean, 1, most)
    words = F.regexp_extract(head, r"(?s)^(.+) [^ ]*$", 1)
    base = F.when(F.locate(" ", head) > 1, words).otherwise(head)
    cut = F.concat(F.regexp_replace(base, r"[\s.,;:–—-]+$", ""), F.lit("…"))
    return F.when(F.length(clean) > most, cut).otherwise(clean)


def joined_parts(*parts: ColumnOrName) -> Column:
    """The parts that aren't empty, with single spaces."""
    return collapsed(F.array_join(F.filter(F.array(*[_col(p) for p in parts]), lambda p: p.isNotNull() & (p != "")), " "))


#: How error texts begin, or what they hold, and the class of each; the first that fits counts.
ERROR_TAGS = (
    ("no-items", "NO_ITEMS"),
    ("ambiguous-multi-item", "AMBIGUOUS_MATCH"),
    ("provider-unavailable", "CONFIG_ERROR"),
)
ERROR_PREFIXES = (
    ("invalid-url:", "INVALID_URL"),
    ("invalid-config:", "CONFIG_ERROR"),
    ("robots-denied:", "ROBOTS_BLOCKED"),
    ("timeout:", "TIMEOUT"),
    ("too-many-redirects:", "TOO_MANY_REDIRECTS"),
    ("no-snapshot:", "NO_SNAPSHOT"),
    ("network:", "FETCH_FAILURE"),
)
ERROR_PARTS = (
    ("http 404", "MISSING_PAGE"),
    ("http 403", "BLOCKED"),
    ("http 500", "SERVER_ERROR"),
    ("http 502", "SERVER_ERROR"),
    ("http 503", "SERVER_ERROR"),
    ("http 522", "SERVER_ERROR"),
    ("page text too short", "JS_OR_THIN_PAGE"),
    ("parse error", "PARSE_FAILURE"),
    ("fetch failed", "FETCH_FAILURE"),
)


def failure_class(error: ColumnOrName) -> Column:
    low = F.lower(_col(error))
    status = F.try_to_number(F.regexp_extract(low, r"http (\d{3})", 1), F.lit("999")).cast("int")
    by_status = (
        F.when(status == 404, "MISSING_PAGE").when(status.isin(401, 403, 429), "BLOCKED").when(status >= 500, "SERVER_ERROR").otherwise("HTTP_ERROR")
    )
    # tags are written after the name of the crawler that gave up, as in x-recrawl:no-items
    found = [F.when(low.rlike(f"^[a-z]+-recrawl:{p}"), c) for p, c in ERROR_TAGS]
    found += [F.when(low.startswith(p), c) for p, c in ERROR_PREFIXES] + [F.when(low.startswith("http-error:"), by_status)]
    return F.coalesce(*found, *[F.when(low.contains(p), c) for p, c in ERROR_PARTS], F.lit("OTHER"))


def resolve_excerpt(excerpt: ColumnOrName, body: ColumnOrName, locator: ColumnOrName) -> Column:
    """struct(state, start, end): where an excerpt stands in a page, in code points, end exclusive.

    With a locator chars:a-b the slice must be the excerpt; without one the excerpt must occur
    exactly once. states: verified, approximate_stale, unavailable (no excerpt or no page)."""
    excerpt, body, locator = _col(excerpt), _col(body), F.nullif(_col(locator), F.lit(""))
    a = F.regexp_extract(locator, r"^chars:(\d+)-(\d+)$", 1).try_cast("int")
    b = F.regexp_extract(locator, r"^chars:(\d+)-(\d+)$", 2).try_cast("int")
    there = F.coalesce((b >= a) & (b <= F.length(body)) & (F.substring(body, a + 1, b - a) == excerpt), F.lit(False))
    first = F.position(excerpt, body)
    again = F.position(excerpt, body, first + 1)
    once = (first > 0) & (again == 0)
    state = F.when(F.coalesce(excerpt == "", F.lit(True)) | body.isNull(), "unavailable")
    state = state.when(locator.isNotNull(), F.when(there, "verified").otherwise("approximate_stale")).when(once, "verified").otherwise("approximate_stale")
    start = F.when(locator.isNotNull(), a).otherwise(first - 1)
    fine = state == "verified"
    return F.struct(state.alias("state"), F.when(fine, start).alias("start"), F.when(fine, start + F.length(excerpt)).alias("end"))
