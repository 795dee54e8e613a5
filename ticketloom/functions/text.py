"""Text, time and number expressions. All stay on the JVM side; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ticket_text(subject: ColumnOrName = "subject", body: ColumnOrName = "body") -> Column:
    """Subject, newline, body: the text the classifiers and rules read."""
    return F.concat_ws("\n", _c(subject), _c(body))


def normalize_text(text: ColumnOrName) -> Column:
    """Lower case with every run of digits replaced by one 0."""
    return F.regexp_replace(F.lower(_c(text)), r"(?U)\d+", "0")


def squeeze(text: ColumnOrName) -> Column:
    """Whitespace runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


#: The white space of Unicode (what (?U)\\s matches): fixed values
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: ColumnOrName) -> Column:
    """Without whitespace of any kind at either end; only the ends are looked at."""
    return F.btrim(_c(text), F.lit(WHITE_SPACE))


def leak_key(text: ColumnOrName) -> Column:
    """Comparison key for evaluation texts: whitespace collapsed, trimmed, lower case."""
    return F.lower(squeeze(text))


def skeleton(text: ColumnOrName) -> Column:
    """Near-duplicate key: lower case, digit runs to 0, no ASCII punctuation, blanks collapsed."""
    return squeeze(F.regexp_replace(normalize_text(text), r"\p{Punct}", ""))


def dedupe_key(text: ColumnOrName) -> Column:
    """Lower case without punctuation and blanks at either end."""
    return F.regexp_replace(F.lower(_c(text)), r"^[\p{Punct} ]+|[\p{Punct} ]+$", "")


def words_of_three(text: ColumnOrName) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(r"[A-Za-z]{3,}"), F.lit(0))


def caps_words(text: ColumnOrName) -> Column:
    return F.filter(words_of_three(text), lambda w: w == F.upper(w))


def caps_ratio(text: ColumnOrName) -> Column:
    """Share of words of three or more letters written in capitals, 0 without such words."""
    return F.coalesce(F.try_divide(F.size(caps_words(text)).cast("double"), F.size(words_of_three(text)).cast("double")), F.lit(0.0))


def count_char(text: ColumnOrName, char: str) -> Column:
    return F.length(_c(text)) - F.length(F.replace(_c(text), F.lit(char), F.lit("")))


def utc_day(ts: ColumnOrName) -> Column:
    """Calendar day of a timestamp under the UTC session."""
    return F.to_date(_c(ts))


# Contact patterns; an unbroken run of digits (an order number) is not a phone
EMAIL_ADDRESS = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PHONE_NUMBER = (
    r"(?<![\w])(?:\+\d[\d\s().-]{7,18}\d|\(?\d{2,4}\)?[\s.-]\d{2,4}[\s.-]\d{3,5}(?:[\s.-]\d{2,5})?)(?![\w])"
)
PHONE_DIGITS = (9, 15)


def mask_emails(text: ColumnOrName) -> Column:
    # most texts hold no address; looking for the sign is far cheaper than trying the pattern
    masked = F.regexp_replace(_c(text), "(?U)" + EMAIL_ADDRESS, "[email]")
    return F.when(F.contains(_c(text), F.lit("@")), masked).otherwise(_c(text))


def mask_contact(text: ColumnOrName) -> Column:
    """E-mail addresses to [email], phone numbers of 9 to 15 digits to [phone].

    The text is cut at every phone-shaped match and put together again, so a match with the wrong
    number of digits keeps its own spelling.
    """
    phone = r"(?U)(?=[+(\d])" + PHONE_NUMBER  # a number starts with one of these
    masked = mask_emails(text)
    gaps = F.split(masked, phone, -1)
    hits = F.regexp_extract_all(masked, F.lit(phone), F.lit(0))

    def stitch(gap: Column, hit: Column) -> Column:
        digits = F.length(F.regexp_replace(hit, r"(?U)\D", ""))
        shown = F.when(digits.between(*PHONE_DIGITS), F.lit("[phone]")).otherwise(F.coalesce(hit, F.lit("")))
        return F.concat(gap, shown)

    return F.when(masked.rlike(phone), F.array_join(F.zip_with(gaps, hits, stitch), "")).otherwise(masked)


def content_fingerprint(text: ColumnOrName) -> Column:
    return F.sha2(_c(text).cast("binary"), 256)


# Fixed value: instruction the retrieval model expects before a query
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def embedding_text(title: ColumnOrName, content: ColumnOrName) -> Column:
    return F.concat(_c(title), F.lit(". "), _c(content))


def query_text(text: ColumnOrName) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), _c(text))


def receipt_ref(ticket_id: ColumnOrName) -> Column:
    return F.upper(F.substring(_c(ticket_id).cast("string"), 1, 8))


def file_suffix(filename: ColumnOrName) -> Column:
    """Lower-case extension with its dot, '' without one."""
    return F.lower(F.regexp_extract(_c(filename), r"[^/.](\.[^./]+)$", 1))


def file_stem(filename: ColumnOrName) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(filename), r"^.*/", ""), r"(?<=[^.])\.[^.]+$", "")


def doc_title(metadata_title: ColumnOrName, text: ColumnOrName, filename: ColumnOrName) -> Column:
    """First non-empty of metadata title, top heading, file name in words, then "Untitled"."""
    heading = F.trim(F.regexp_extract(_c(text), r"^#\s+(.+)", 1))
    stem = F.trim(F.translate(file_stem(filename), "_-", "  "))
    blank = F.lit("")
    return F.left(
        F.coalesce(F.nullif(F.trim(_c(metadata_title)), blank), F.nullif(heading, blank), F.nullif(stem, blank), F.lit("Untitled")),
        F.lit(200),
    )


def normalise_document(text: ColumnOrName) -> Column:
    """Unix line ends, no blanks before them, at most one empty line, no outer whitespace."""
    unix = F.regexp_replace(_c(text), "\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(unix, "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))


def word_tokens(text: ColumnOrName) -> Column:
    """Number of whitespace-separated words; the token counter of the chunker and length checks."""
    return F.size(F.filter(F.split(_c(text), r"(?U)\s+"), lambda w: w != ""))


def one_decimal(x: Column) -> Column:
    """A non-negative number with one decimal, halves up."""
    tenths = F.floor(x * 10 + F.lit(0.5)).cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def whole(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("bigint").cast("string")


def human_duration(seconds: ColumnOrName) -> Column:
    """Seconds as text: s below a minute, min below an hour, h below two days, else days."""
    s = _c(seconds).cast("double")
    minutes, hours = s / 60, s / 60 / 60
    return (
        F.when(s.isNull(), F.lit("–"))
        .when(s < 60, F.concat(whole(s), F.lit("s")))
        .when(minutes < 60, F.concat(whole(minutes), F.lit(" min")))
        .when(hours < 10, F.concat(one_decimal(hours), F.lit(" h")))
        .when(hours < 48, F.concat(whole(hours), F.lit(" h")))
        .otherwise(F.concat(one_decimal(hours / 24), F.lit(" days")))
    )


def human_percent(value: ColumnOrName) -> Column:
    v = _c(value).cast("double")
    return F.when(v.isNull(), F.lit("–")).otherwise(F.concat(whole(v * 100), F.lit("%")))


def human_millis(ms: ColumnOrName) -> Column:
    m = _c(ms)
    return (
        F.when(m.isNull(), F.lit("–"))
        .when(m < 1000, F.concat(m.cast("string"), F.lit(" ms")))
        .otherwise(F.concat(one_decimal(m / 1000), F.lit(" s")))
    )


def fill_placeholders(text: ColumnOrName, values: dict[str, Column]) -> Column:
    """Replace each known {{Name}} slot by its value and every other slot by nothing."""
    out = _c(text)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return F.regexp_replace(out, r"\{\{[^}]+\}\}", "")


def pick(options: list[str], key: Column) -> Column:
    """One of `options`, chosen by a hash key, so the same row always picks the same one."""
    position = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") % len(options)
    return F.element_at(F.array(*map(F.lit, options)), (position + 1).cast("int"))
