"""Text functions: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without content, words of addresses, and number words in order from zero.
STOPWORDS = "the a an of in at on for to and or by from with into is was were be been being".split()
ADDRESS_WORDS = (
    "street st road rd lane ln avenue ave drive dr place pl square sq close court ct way high highstreet "
    "boulevard blvd city town village county country oxford cambridge"
).split()
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
).split()
DAY_NAMES = "monday mon tuesday tue tues wednesday wed thursday thu thurs friday fri saturday sat sunday sun".split()
ABSTENTIONS = (
    "unknown", "abstention", "no information", "not available", "no evidence", "no evidnece", "insufficient information",
)
VIDEO_SUFFIXES = ("mp4", "mov", "avi", "mkv", "webm")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "heic", "webp", "gif", "bmp")


def blank(c: Column | str) -> Column:
    """Null counts as the empty string."""
    return F.coalesce(_c(c), F.lit(""))


def filled(c: Column | str) -> Column:
    """The empty string counts as null."""
    return F.nullif(blank(c), F.lit(""))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def tokens(c: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(blank(c)), "[^a-z0-9]+"), "")


def token_count(c: Column | str) -> Column:
    """The number of `tokens`, without making them."""
    return F.regexp_count(F.lower(blank(c)), F.lit("[a-z0-9]+"))


def whitespace_tokens(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(F.trim(blank(c))), r"\s+"), lambda t: t != "")


def stem(path: Column | str) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_extract(_c(path), r"([^/]+?)(\.[^./]*)?$", 1)


def safe_filename(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"[^\p{L}\p{N}_\-]", "_")


def normalize_text(c: Column | str) -> Column:
    """Lower case, one space, no ordinal endings, no parentheses, no digit commas, no punctuation at the ends."""
    c = squeeze(F.lower(_c(c)))
    c = F.regexp_replace(c, r"\b(\d+)(st|nd|rd|th)\b", "$1")
    c = F.regexp_replace(c, r"\([^)]+\)", "")
    c = F.regexp_replace(c, r"\s+", " ")
    c = F.regexp_replace(c, r"(\d),(\d)", "$1$2")
    return F.regexp_replace(c, r"""^[\t\n\r "'`.,;:!?()\[\]{}]+|[\t\n\r "'`.,;:!?()\[\]{}]+$""", "")


def preprocess(c: Column | str) -> Column:
    """No final dots, no digit commas, no unit after a count."""
    c = F.regexp_replace(_c(c), r"\.+$", "")
    c = F.regexp_replace(c, r"(\d),(\d)", "$1$2")
    return F.regexp_replace(c, r"(?i)\b(\d+)\s+(spots?|hours?|sessions?|days?)\b", "$1")


def strip_parentheses(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(_c(c), r"\([^)]+\)", ""))


def strip_breakdowns(c: Column | str) -> Column:
    """No itemised amounts after a total."""
    c = F.regexp_replace(_c(c), r"(?i),?\s*totaling\s+[£$€]\d+(?:\.\d+)?\s+for\s+\w+\s+sessions?", "")
    c = F.regexp_replace(c, r"(?i),?\s*comprising\s+.*$", "")
    return squeeze(F.regexp_replace(c, r"(?i)per\s+\d+[- ]minute\s+session", "per session"))


def between_to_range(c: Column | str) -> Column:
    """`between X and Y` as `X to Y`; every `and` becomes `to`."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"(?i)\bbetween\s+", ""), r"(?i)\s+and\s+", " to ")


def strip_article(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"(?i)^\s*(a|an|the)\s+", "")


#: Phrases around an answer that do not change it. One of them takes a digit with it.
CONTEXT_PHRASES = (
    r"\bit happened on\b", r"\bstarting at\b", r"\bfrom\s+\d", r"\bonwards\b", r"\btotaling\b", r"\bcomprising\b", r"\bwith pre-drinks at\b",
    r"\bwith pre-\w+\b", r"\band dinner at\b", r"\bdress code is\b", r"\bthe total cost was\b", r"\bcode:\s*", r"\bexpires?\s*",
)


def strip_context(c: Column | str) -> Column:
    c = F.lower(_c(c))
    for phrase in (*CONTEXT_PHRASES, r"\b(" + "|".join(DAY_NAMES) + r")\b"):
        c = F.regexp_replace(c, phrase, " ")
    return squeeze(c)


def clean_answer(c: Column | str) -> Column:
    """The form of an answer that the exact match compares."""
    return strip_article(between_to_range(strip_breakdowns(strip_parentheses(preprocess(blank(c))))))


def is_abstention(c: Column | str) -> Column:
    return normalize_text(blank(c)).rlike("|".join(ABSTENTIONS))


def split_list(c: Column | str) -> Column:
    """The normalised items of a written list."""
    parts = F.split(blank(c), r"(?i)\s*(?:,|;|\band\b|/)\s*")
    return F.transform(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), normalize_text)


def number_words(c: Column | str) -> Column:
    """Number words from zero to twenty as digits."""
    c = _c(c)
    for value, word in enumerate(NUMBER_WORDS):
        c = F.regexp_replace(c, rf"(?i)\b{word}\b", str(value))
    return c


def content_tokens(c: Column | str) -> Column:
    return F.filter(tokens(c), lambda t: ~t.isin(STOPWORDS))


def token_subset(truth: Column, prediction: Column) -> Column:
    """Whether all content tokens of the truth are in the prediction; true if there are none."""
    return F.size(F.array_except(content_tokens(truth), tokens(prediction))) == 0


def address_match(truth: Column, prediction: Column) -> Column:
    words = F.filter(content_tokens(truth), lambda t: ~t.rlike("^[0-9]+$"))
    is_address = F.exists(tokens(truth), lambda t: t.isin(ADDRESS_WORDS))
    return is_address & (F.size(words) > 0) & (F.size(F.array_except(words, tokens(prediction))) == 0)


def memory_ids(c: Column | str) -> Column:
    """Ids of media (YYYYMMDD_HHMMSS), then of emails, that a text mentions."""
    c = blank(c)
    media = F.regexp_extract_all(c, F.lit(r"\b(\d{8}_\d{6})\b"), F.lit(1))
    mails = F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\b(email\d+)\b"), F.lit(1)), F.lower)
    return F.array_distinct(F.concat(media, mails))


def list_items(prediction: Column | str) -> Column:
    """The ids that a prediction mentions, or else its list items."""
    ids = memory_ids(prediction)
    return F.when(F.size(ids) > 0, ids).otherwise(F.filter(split_list(prediction), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b|; 1 for two empty sets, 0 if only the first is empty."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ == 0, F.lit(1.0)).when(F.size(a) == 0, F.lit(0.0)).otherwise(both / all_)


def evidence_kind(item_id: Column | str) -> Column:
    """email, video or image by an id's form, else unknown."""
    low = F.lower(_c(item_id))
    return (
        F.when(low.startswith("email"), "email")
        .when(low.rlike(r"\.(" + "|".join(VIDEO_SUFFIXES) + r")$"), "video")
        .when(low.rlike(r"\.(" + "|".join(IMAGE_SUFFIXES) + r")$"), "image")
        .otherwise("unknown")
    )


def evidence_mix(ids: Column | str) -> Column:
    """email, media or mixed, for a list of ids."""
    mail = F.exists(_c(ids), lambda x: F.lower(x).startswith("email"))
    media = F.exists(_c(ids), lambda x: ~F.lower(x).startswith("email"))
    return F.when(mail & media, "mixed").when(mail, "email").otherwise("media")


def trimmed(c: Column | str, most: int) -> Column:
    """At most `most` characters, with dots where it was cut."""
    c = _c(c)
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.left(c, F.lit(most))), F.lit(" ..."))).otherwise(c)


def clean_city(c: Column | str) -> Column:
    """`City, Country` from a city field that may hold several lines."""
    lines = F.filter(F.transform(F.split(F.trim(blank(c)), "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def after(mark: str) -> Column:
        return F.try_element_at(F.transform(F.filter(lines, lambda x: F.lower(x).startswith(mark)), lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", ""))), F.lit(-1))

    city, country = filled(after("city:")), filled(after("country:"))
    named = F.concat_ws(", ", city, country)
    return F.when(F.size(lines) <= 1, F.trim(blank(c))).when(city.isNotNull(), named).otherwise(blank(F.try_element_at(lines, F.lit(1))))


def parse_tags(c: Column | str) -> Column:
    """Lower-case tags of more than one character, each once."""
    parts = F.transform(F.split(F.lower(blank(c)), ","), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) > 1))


def parse_entities(c: Column | str) -> Column:
    """(entity, type) from a JSON list, or else from lines `name: type`."""
    c = blank(c)
    json = F.from_json(F.regexp_extract(c, r"(?s)\[.*\]", 0), "array<struct<entity:string,type:string>>")
    lines = F.filter(F.split(c, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("entity"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("type")))
    return F.when(F.size(json) > 0, json).otherwise(pairs)


def sender_name(c: Column | str) -> Column:
    """The display name of a sender, or else the words of the address."""
    c = F.trim(blank(c))
    shown = F.trim(F.regexp_extract(c, r"""^"?([^"<@]+?)"?\s*<""", 1))
    local = F.initcap(F.regexp_replace(F.regexp_extract(c, r"([^<@\s]+)@", 1), r"[._\-]+", " "))
    return F.coalesce(filled(shown), filled(local), c)


def email_address(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(blank(c), r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})", 1))


def subject(detail: Column | str) -> Column:
    return F.trim(F.regexp_extract(blank(detail), r"(?m)^Subject:\s*(.+)$", 1))


def leading_id(c: Column | str) -> Column:
    """The id of a text whose first line is `ID: ...` or that starts with `[id]`."""
    c = blank(c)
    return F.coalesce(filled(F.trim(F.regexp_extract(c, r"(?m)^\s*ID:\s*(\S+)", 1))), filled(F.regexp_extract(c, r"^\s*\[([^\]]+)\]", 1)), F.lit(""))


def source_ids(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(blank(c), F.lit(r"SOURCE_ID:\s*([A-Za-z0-9_]+)"), F.lit(1)))


def html_plain(html: Column | str) -> Column:
    """The whole readable text of a page: no scripts, styles, comments or tags, few entities, one space; null stays null."""
    c = _c(html)
    for pattern in (r"(?is)<script\b[^>]*>.*?</script>", r"(?is)<style\b[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"(?is)<img\b[^>]*>", r"(?s)<[^>]+>"):
        c = F.regexp_replace(c, pattern, " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f]+", " "))


def shortened(c: Column | str, most: int = 50_000) -> Column:
    """At most so many characters of a text, with a mark where something is left out."""
    c = _c(c)
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def html_to_text(html: Column | str, most: int = 50_000) -> Column:
    """The readable text of a page, `html_plain`, cut to its first characters; null counts as empty."""
    return shortened(html_plain(blank(html)), most)


def html_title(html: Column | str) -> Column:
    return F.trim(F.regexp_extract(blank(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def attachment_names(c: Column | str) -> Column:
    """File names of attachment lines, longer than three characters, each once."""
    found = F.regexp_extract_all(blank(c), F.lit(r"(?im)^\s*attachments?:\s*(.+)$"), F.lit(1))
    names = F.flatten(F.transform(found, lambda x: F.transform(F.split(x, "[,;]"), lambda x: F.trim(x))))
    return F.array_distinct(F.filter(names, lambda x: F.length(x) > 3))
