"""Scalar functions on product listings, URLs, prices and run messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a product as jewelry.
JEWELRY_WORDS = [
    "jewelry", "jewellery", "ring", "rings", "necklace", "necklaces", "earring", "earrings", "bracelet", "bracelets", "bangle", "bangles",
    "anklet", "anklets", "pendant", "pendants", "brooch", "brooches", "chain", "chains", "charm", "charms", "cufflink", "cufflinks",
]
#: Patterns of product URLs and of URLs that are none.
PRODUCT_URL = r"(/products/|/p/[^/]+/|\.html$|/[a-z0-9-]+-by-[a-z0-9-]+)"
OTHER_URL = r"(/collections/?$|/category/?$|/search|/cart|/account|/blogs|\?|#)"
IMAGE_URL = r"(?i)https?://[^\s\"'()<>]+\.(?:jpg|jpeg|png|webp)(?:\?[^\s\"'()<>]*)?"


def or_else(value: Column, default) -> Column:
    """``default`` where ``value`` is null or the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def strip(value: Column) -> Column:
    """Without white space at either end, no-break spaces and others beyond ASCII included."""
    space = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
    return F.regexp_replace(value, f"^{space}|{space}$", "")


def contains_any(value: Column, *needles: str) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(value, F.lit(n))
    return out


def normalize_tags(tags: Column) -> Column:
    """An array of tags from a JSON list or a comma-separated string."""
    raw = F.coalesce(tags, F.lit(""))
    parts = F.when(raw.startswith("["), F.coalesce(F.from_json(raw, "array<string>"), F.array())).otherwise(F.split(raw, ","))
    filled = F.filter(parts, lambda t: t.isNotNull() & (strip(t) != ""))
    return F.transform(filled, lambda t: strip(F.translate(t, "_-", "  ")))


def is_jewelry(product_type: Column, tags: Column, title: Column, words: list[str] | None = None) -> Column:
    """Whether type, title or normalised tags hold one of the words."""
    text = F.concat_ws(" ", F.coalesce(product_type, F.lit("")), F.coalesce(title, F.lit("")), F.array_join(normalize_tags(tags), " "))
    return text.rlike(r"(?i)\b(" + "|".join(words or JEWELRY_WORDS) + r")\b")


def strip_html(html: Column) -> Column:
    """Each tag becomes a blank; entities and inner white space stay."""
    return strip(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "))


def base_url(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def clean_url(url: Column) -> Column:
    """Without parameters, query and fragment, the scheme in lower case, at most 140 characters."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r";[^/]*$", "")
    scheme = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return F.substring(F.concat(F.lower(scheme), F.substring(bare, F.char_length(scheme) + 1, F.char_length(bare))), 1, 140)


def collection_handle(url: Column) -> Column:
    """The path segment after ``/collections/``, or null."""
    return F.nullif(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/collections/([^/]+)", 1), F.lit(""))


def page_url(url: Column, page: Column) -> Column:
    """The URL with its whole query replaced by ``p=page``; the fragment stays."""
    return F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.lit("?p="), page.cast("string"), F.regexp_extract(url, r"(#.*)$", 1))


def link_next(header: Column) -> Column:
    """The URL of the first part of a Link header with rel="next", or null."""
    nexts = F.filter(F.split(F.coalesce(header, F.lit("")), ","), lambda p: F.contains(p, F.lit('rel="next"')) & p.rlike("<[^>]+>"))
    return F.regexp_extract(F.get(nexts, 0), "<([^>]+)>", 1)


def product_url(endpoint: Column, handle: Column) -> Column:
    base = F.substring_index(F.substring_index(endpoint, "/collections/", 1), "/products", 1)
    return F.when(or_else(handle, "") == "", "").otherwise(F.concat(base, F.lit("/products/"), handle))


def is_product_url(url: Column) -> Column:
    return ~url.rlike(OTHER_URL) & url.rlike(PRODUCT_URL)


def parse_price(text: Column) -> Column:
    """The first number in a price, commas removed, or 0."""
    number = F.regexp_extract(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit("")), r"([0-9]+\.?[0-9]*)", 1)
    return F.coalesce(F.nullif(number, F.lit("")).try_cast("double"), F.lit(0.0))


def format_price(price: Column) -> Column:
    return F.when(F.coalesce(price, F.lit(0.0)) != 0, F.format_string("$%.2f", price)).otherwise("—")


def item_code(sku: Column, name: Column) -> Column:
    """The trimmed SKU, or a code from the name with a suffix that repeats from run to run."""
    kept = F.substring(strip(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9\s]", "")), 1, 30)
    suffix = F.upper(F.substring(F.sha2(F.coalesce(name, F.lit("")), 256), 1, 6))
    return F.coalesce(F.nullif(strip(sku), F.lit("")), F.concat(or_else(kept, "ITEM"), F.lit("-"), suffix))


def image_urls(markdown: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(markdown, F.lit("")), F.lit(IMAGE_URL), F.lit(0))


def images_topup(images: Column, markdown: Column, most: int = 5) -> Column:
    """Images completed from markdown to ``most`` distinct ones, where there are fewer."""
    short = (F.size(images) < most) & (F.coalesce(markdown, F.lit("")) != "")
    return F.when(short, F.slice(F.array_distinct(F.concat(images, image_urls(markdown))), 1, most)).otherwise(images)


def file_name(collection: Column) -> Column:
    return F.concat(F.translate(or_else(collection, "collection"), " /", "_-"), F.lit("_factory.xlsx"))


def html_escape(text: Column, quotes: bool = True) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))[: 4 if quotes else 3]:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def comma_list(text: Column) -> Column:
    """The filled parts of a comma-separated list."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip), lambda t: t != "")


def error_kind(message: Column) -> Column:
    """The first that applies of credits, key, rate, timeout, network; else other."""
    low = F.lower(message)
    return (
        F.when(contains_any(message, "402", "Payment Required", "Insufficient credits"), "credits")
        .when(contains_any(message, "401", "Unauthorized", "Token missing"), "key")
        .when(contains_any(message, "429") | contains_any(low, "rate limit"), "rate")
        .when(contains_any(low, "timeout", "timed out"), "timeout")
        .when(contains_any(low, "connection", "network"), "network")
        .otherwise("other")
    )


def friendly_message(message: Column, service: str = "the scraping service") -> Column:
    """What a user is told of an error, by :func:`error_kind`; our own wording."""
    kind = error_kind(message)
    told = F.when(kind == "credits", f"Out of credits at {service}").when(kind == "key", f"The key of {service} is invalid or missing")
    told = told.when(kind == "rate", "Rate limit hit — wait a few minutes and try again").when(kind == "timeout", F.concat(F.lit("Request timed out scraping "), F.substring(message, 1, 80)))
    return told.when(kind == "network", f"Network error — could not reach the site or {service}").otherwise("Scrape failed unexpectedly — check the error log for details")


def connection_message(message: Column) -> Column:
    """What a failed connection test says; the texts are fixed values."""
    low = F.lower(message)
    return (
        F.when(contains_any(message, "401") | contains_any(low, "unauthorized"), "Invalid API key (401 Unauthorized)")
        .when(contains_any(message, "403") | contains_any(low, "forbidden"), "Access denied (403 Forbidden)")
        .otherwise(F.concat(F.lit("Connection failed: "), message))
    )


def retry_class(message: Column) -> Column:
    """abort (credits), wait (rate limit or timeout) or skip."""
    low = F.lower(message)
    credits = contains_any(message, "402", "Payment Required", "Insufficient credits") | (contains_any(message, "401") & contains_any(message, "Token missing"))
    return F.when(credits, "abort").when(contains_any(message, "429") | contains_any(low, "rate limit", "timeout", "timed out"), "wait").otherwise("skip")


def duration_text(seconds: Column) -> Column:
    return F.when(seconds > 60, F.format_string("%dm %ds", F.expr("0").cast("long") + F.floor(seconds / 60), seconds % 60)).otherwise(F.format_string("%ds", seconds))


def badge_text(status: Column, message: Column) -> Column:
    """The word on a site's badge; a fixed value each."""
    low = F.lower(F.coalesce(message, F.lit("")))
    failed = F.when(F.contains(low, F.lit("credit")), "No Credits").when(F.contains(low, F.lit("rate limit")), "Rate Limited").when(contains_any(low, "timed out", "timeout"), "Timed Out").otherwise("Failed")
    return F.when(status == "Failed", failed).when(status.isin("Done", "Running"), status).otherwise("Queued")


def done_text(saved: Column, known: Column, found: Column) -> Column:
    """The line of a finished site; the texts are fixed values."""
    return (
        F.when((saved == 0) & (known == 0) & (found == 0), "No products found on this site")
        .when((known > 0) & (saved == 0), F.format_string("%d already in DB — all up to date", known))
        .when(known > 0, F.format_string("%d new · %d already saved", saved, known))
        .otherwise(F.concat(F.format_string("%d new product", saved), F.when(saved != 1, "s").otherwise(""), F.lit(" saved")))
    )


def progress_line(status: Column, saved: Column, known: Column, found: Column, seconds: Column, log: Column) -> Column:
    """The line under a site: its error, its result, how far it is, or that it waits. The texts are fixed values."""
    time = F.concat(F.lit("("), duration_text(seconds), F.lit(")"))
    running = F.when(found > 0, F.concat(F.format_string("%d new saved so far · %d scanned ", saved, found), time)).otherwise(F.concat(F.lit("Scanning site… "), time))
    return F.when(status == "Failed", or_else(log, "Unknown error")).when(status == "Done", done_text(saved, known, found)).when(status == "Running", running).otherwise("Waiting in queue…")


def plural(count: Column, noun: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {noun}"), F.when(count != 1, "s").otherwise(""))


def run_summary(saved: Column, known: Column, sites: Column, any_failed: Column) -> Column:
    """The text under a finished run; its wording is a fixed value."""
    head = F.concat(F.when(any_failed, "⚠️ ").otherwise("✅ "), F.regexp_replace(plural(saved, "new product"), "$", " found across "), plural(sites, "site"))
    note = F.when((saved == 0) & (known > 0), F.concat(F.lit(" Everything was already up to date — "), plural(known, "product"), F.lit(" matched existing entries.")))
    warning = F.when(any_failed, F.lit(" One or more sites had issues — see the cards below for details."))
    return F.concat(head, F.coalesce(note, F.lit("")), F.coalesce(warning, F.lit("")))


def raw_price(text: Column) -> Column:
    """A price as recorded, with a dollar sign before it."""
    return F.concat(F.lit("$"), F.coalesce(text, F.lit("")))


def image_extension(content_type: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(contains_any(kind, "png", "webp"), "png").when(F.contains(kind, F.lit("gif")), "gif").otherwise("jpeg")


def scaled_width(width: Column, height: Column, target: int = 120) -> Column:
    return F.floor(width * target / F.greatest(height, F.lit(1))).cast("long")
