"""Text functions as column expressions. Null gives null unless said otherwise; white space and words are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.config import STOP_WORDS_EN, STOP_WORDS_ZH

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
# The addresses that are accepted.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
# Not fixed: what counts as a URL here needs a host, which is checked after the match.
URL = r"https?://[A-Za-z0-9$\-_@.&+!*(),%/:=?~#]+"


def stripped(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def strip_tags(t: Column) -> Column:
    return F.regexp_replace(t, r"<[^>]+>", "")


def normalize_whitespace(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def simple_clean(t: Column) -> Column:
    """Without tags and runs of white space; stays in the JVM (``similarity.clean_text`` also does entities and NFKC)."""
    return normalize_whitespace(strip_tags(t))


def strip_punctuation(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)[^\w\s一-鿿。，！？；：“”‘’（）【】]", "")


def detect_language(t: Column) -> Column:
    """zh, en, mixed or unknown from the numbers of Han and Latin runs."""
    zh, en = F.regexp_count(t, F.lit(r"[一-鿿]+")), F.regexp_count(t, F.lit(r"[a-zA-Z]+"))
    total = F.nullif((zh + en).cast("double"), F.lit(0.0))
    z, e = zh / total, en / total
    return F.when(z > 0.6, "zh").when(e > 0.6, "en").when((z > 0.2) & (e > 0.2), "mixed").otherwise("unknown")


def sentences(t: Column) -> Column:
    """Array of trimmed, non-empty sentences; full-width marks end them in Han texts, ASCII ones else."""
    cut = lambda marks: F.filter(F.transform(F.split(t, marks), stripped), lambda s: s != "")
    return F.when(detect_language(t) == "zh", cut("[。！？；]")).otherwise(cut("[.!?;]"))


def chunks(t: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Pieces of a fixed size and stride; a text within the size is its own only piece, an empty one has none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    cut = F.transform(F.sequence(F.lit(0), F.length(t) - 1, F.lit(size - overlap)), lambda i: F.substring(t, i + 1, F.lit(size)))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) <= size, F.array(t)).otherwise(cut)


def sentence_chunks(t: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Sentences packed up to ``size``, joined by spaces; only a sentence above it is cut, with overlap."""
    state = "struct<done:array<string>,held:string>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def add(s: Column, x: Column) -> Column:
        joined = F.when(s["held"] == "", x).otherwise(F.concat(s["held"], F.lit(" "), x))
        done = F.when(s["held"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["held"])))
        fits = F.length(joined) <= size
        long = F.length(x) > size
        return F.struct(F.when(fits, s["done"]).when(long, F.concat(done, chunks(x, size, overlap))).otherwise(done).alias("done"), F.when(fits, joined).when(long, F.lit("")).otherwise(x).alias("held")).cast(state)

    packed = F.aggregate(sentences(t), start.cast(state), add, lambda s: F.when(s["held"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["held"]))))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) <= size, F.array(t)).otherwise(packed)


def words(t: Column) -> Column:
    """Lower-case words."""
    return F.regexp_extract_all(F.lower(simple_clean(t)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def tokens(t: Column, zh: Column) -> Column:
    """Words, or characters of a Han text (``zh``)."""
    return F.when(zh, F.regexp_extract_all(simple_clean(t), F.lit(r"(?U)\S"), F.lit(0))).otherwise(words(t))


def token_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, zh, pos, word) of every token; the language of a text is found once."""
    held = df.select(key, (detect_language(F.col(text)) == "zh").alias("zh"), text)
    return held.select(key, "zh", F.posexplode(tokens(F.col(text), F.col("zh"))).alias("pos", "word"))


def word_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, n, first): counts of each text's words and where each comes first. Texts of one key are expected to be one row."""
    return token_rows(df, key, text).groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def keywords(df: DataFrame, key: str, text: str, k: int = 10, shortest: int = 2) -> DataFrame:
    """(key, word, n, rank) of the k most frequent words that are no stop words; ties go to the first to occur."""
    stop = F.when(F.col("zh"), F.col("word").isin(*STOP_WORDS_ZH)).otherwise(F.col("word").isin(*STOP_WORDS_EN))
    kept = token_rows(df, key, text).filter((F.length("word") >= shortest) & ~stop)
    counted = kept.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(key, "word", "n", "rank")


def urls(t: Column) -> Column:
    """URLs of a text that have a host."""
    found = F.regexp_extract_all(t, F.lit(URL), F.lit(0))
    return F.filter(found, lambda u: F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit("")) != "")


def sanitize(t: Column, longest: int = 10_000) -> Column:
    """Cut to ``longest``, without control characters, tags and runs of white space."""
    return simple_clean(F.regexp_replace(F.substring(t, 1, longest), CONTROL, ""))


def sanitize_filename(t: Column, longest: int = 255) -> Column:
    """A safe file name: unsafe signs become one underscore, the extension survives the cut, 'untitled' if nothing is left."""
    safe = F.regexp_replace(F.regexp_replace(t, r'[<>:"/\\|?*\x00-\x1F]', "_"), "_+", "_")
    safe = F.regexp_replace(safe, "^[_ ]+|[_ ]+$", "")
    ext = F.regexp_extract(safe, r"^.+(\.[^.]+)$", 1)
    cut = F.when(F.length(safe) <= longest, safe).otherwise(F.concat(F.substring(safe, F.lit(1), longest - F.length(ext)), ext))
    return F.when(F.coalesce(F.length(cut), F.lit(0)) == 0, "untitled").otherwise(cut)


def is_email(t: Column) -> Column:
    """Format and length limits of an address."""
    local, domain = F.substring_index(t, "@", 1), F.substring_index(t, "@", -1)
    parts = F.split(domain, r"\.")
    return F.coalesce(t.rlike(EMAIL) & (F.length(t) <= 254) & (F.length(local) <= 64) & (F.length(domain) <= 253) & (F.size(parts) >= 2) & F.forall(parts, lambda p: F.length(p).between(1, 63)), F.lit(False))


def is_clean(t: Column) -> Column:
    """Valid UTF-8 without control characters."""
    return F.is_valid_utf8(t) & ~t.rlike(CONTROL)


def file_kind(name: Column) -> Column:
    """Kind of a file by its extension."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    kinds = {"pdf": ("pdf",), "word": ("doc", "docx"), "powerpoint": ("ppt", "pptx"), "image": ("png", "jpg", "jpeg", "gif", "bmp", "tiff", "webp"), "markdown": ("md", "markdown"), "text": ("txt",)}
    return F.coalesce(*(F.when(ext.isin(*v), k) for k, v in kinds.items()), F.lit("unknown"))


def name_parts(name: Column) -> Column:
    """Struct (document, page, index) out of an image's file name ``doc_p001_img002.ext``; nulls where it has another form."""
    form = r"^(.+)_p(\d+)_img(\d+)\.[A-Za-z]+$"
    part = lambda k: F.nullif(F.regexp_extract(name, form, k), F.lit(""))
    return F.struct(part(1).alias("document"), part(2).cast("int").alias("page"), part(3).cast("int").alias("index"))


def name_pattern(name: Column) -> Column:
    """Which naming scheme a file name follows."""
    return F.when(name.rlike(r"^.+_p\d+_img\d+_\d{10,}\.[A-Za-z]+$"), "stamped").when(name.rlike(r"^.+_p\d+_img\d+\.[A-Za-z]+$"), "standard").when(name.rlike(r"^[0-9a-f]{16,}\.[A-Za-z]+$"), "hashed").otherwise("other")


def chat_tokens(t: Column) -> Column:
    """Estimated tokens of a message: a quarter of its characters and 3."""
    return F.coalesce(F.floor(F.length(t) / 4).cast("long"), F.lit(0)) + 3
