"""Column functions over message text, links, file names and paths. All run inside Spark's generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a status link is, which files are videos or images, what is cleaned from an announcement (each pattern with what replaces it).
STATUS_LINK = r"https?://(?:twitter\.com|x\.com)/(\w+)/status/\d+"
VIDEO_EXTENSIONS = (".mp4", ".mov", ".m4v", ".avi", ".mkv", ".webm")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "heic", "heif", "webp", "tiff", "tif")
ANNOUNCEMENT_CLEANING = (
    (r"(?U)\[#(\w+)\]\(<[^>]+>\)", "#$1"),
    (r"\[([^\]]+)\]\(<[^>]+>\)", "$1"),
    (r"(?U)https?://twitter\.com/\S+/status/\d+", ""),
    (r"(?U)https?://x\.com/\S+/status/\d+", ""),
    (r"(?U)\s+", " "),
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filled(x: Column | str) -> Column:
    """An empty string as null."""
    return F.nullif(_c(x), F.lit(""))


def any_of(conditions: Sequence[Column]) -> Column:
    """Whether one of the conditions holds; false for none."""
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def is_announcement(text: Column | str, keywords: Sequence[str]) -> Column:
    """Substring of the lower-cased text; keywords are taken as they are, so one with capitals never matches."""
    lowered = F.lower(F.coalesce(_c(text), F.lit("")))
    return any_of([lowered.contains(F.lit(k)) for k in keywords])


def is_always_curate(author: Column | str, accounts: Sequence[str]) -> Column:
    """Substring of the author, both lower-cased; false without an author or accounts."""
    lowered = F.lower(F.coalesce(_c(author), F.lit("")))
    return (lowered != "") & any_of([lowered.contains(F.lit(a.lower())) for a in accounts])


def clean_author(author: Column | str) -> Column:
    """The author without the relay's suffix, trimmed."""
    return F.regexp_replace(F.regexp_replace(_c(author), r"(?iU)\s*[•·]\s*TweetShift\s*$", ""), r"(?U)^\s+|\s+$", "")


def tweet_url(text: Column | str) -> Column:
    """The first status link, null if there is none."""
    return filled(F.regexp_extract(_c(text), "(?U)" + STATUS_LINK, 0))


def tweet_user(text: Column | str) -> Column:
    """The user of the first status link, null if there is none."""
    return filled(F.regexp_extract(_c(text), "(?U)" + STATUS_LINK, 1))


def file_ext(url: Column | str) -> Column:
    """The extension of the last path segment with its dot and case; .jpg if there is none."""
    name = F.substring_index(F.substring_index(_c(url), "/", -1), "?", 1)
    return F.when(name.contains("."), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise(".jpg")


def url_hash(url: Column | str) -> Column:
    return F.substring(F.md5(_c(url)), 1, 8)


def media_filename(url: Column | str, link: Column | str, author: Column | str, username: Column | str, now: Column) -> Column:
    """name_time_hash.ext: the user's name, else the link's user, else the author, 20 characters of it at most; without any name, no leading part."""
    name = F.coalesce(filled(username), tweet_user(link), filled(author))
    clean = F.substring(F.regexp_replace(F.replace(name, F.lit(" "), F.lit("_")), r"(?U)[^\w\-]", ""), 1, 20)
    return F.concat(F.coalesce(F.concat(clean, F.lit("_")), F.lit("")), F.date_format(now, "yyyyMMdd_HHmmss"), F.lit("_"), url_hash(url), file_ext(url))


def clean_announcement(text: Column | str) -> Column:
    """Text without link syntax and status links, white space collapsed."""
    out = F.coalesce(_c(text), F.lit(""))
    for pattern, by in ANNOUNCEMENT_CLEANING:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def render_announcement(author: Column | str, link: Column | str, text: Column | str, now: Column) -> Column:
    """A log entry; a null author is written None, a missing link has no line."""
    head = F.concat(F.lit("\n---\nDate: "), F.date_format(now, "yyyy-MM-dd HH:mm"), F.lit("\nFrom: "), F.coalesce(_c(author), F.lit("None")))
    return F.concat(head, F.coalesce(F.concat(F.lit("\nLink: "), filled(link)), F.lit("")), F.lit("\n\n"), clean_announcement(text), F.lit("\n"))


def media_description(author: Column | str, link: Column | str) -> Column:
    return F.concat(F.coalesce(F.concat(F.lit("Author: "), filled(author), F.lit("\n")), F.lit("")), F.coalesce(F.concat(F.lit("Source: "), filled(link)), F.lit("")))


def basename(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def is_video(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"(\.[^./]+)$", 1)).isin(*VIDEO_EXTENSIONS)


def sniff_format(content: Column | str) -> Column:
    """jpeg or png by the first bytes, else other."""
    c = _c(content)
    return F.when(F.hex(F.substring(c, 1, 2)) == "FFD8", "jpeg").when(F.hex(F.substring(c, 1, 4)) == "89504E47", "png").otherwise("other")


def preview(text: Column | str, n: int = 100) -> Column:
    return F.substring(_c(text), 1, n)


def _is_gif(url: Column) -> Column:
    return F.lower(url).endswith(".gif")


def image_urls(attachments: Column | str = "attachments", embeds: Column | str = "embeds") -> Column:
    """Image attachments but GIFs, then each embed's image and its thumbnail over 100 pixels wide, but GIFs."""
    mine = F.transform(F.filter(_c(attachments), lambda a: a["content_type"].startswith("image") & ~F.lower(a["content_type"]).contains("gif")), lambda a: a["url"])
    one = lambda e: F.array(
        F.when(~_is_gif(filled(e["image"]["url"])), e["image"]["url"]),
        F.when((e["thumbnail"]["width"] > 100) & ~_is_gif(filled(e["thumbnail"]["url"])), e["thumbnail"]["url"]),
    )
    return _joined(mine, F.flatten(F.transform(_c(embeds), one)))


def video_urls(attachments: Column | str = "attachments", embeds: Column | str = "embeds") -> Column:
    """Video and GIF attachments, then each embed's video, GIF image and GIF thumbnail."""
    mine = F.transform(F.filter(_c(attachments), lambda a: a["content_type"].startswith("video") | F.lower(a["content_type"]).contains("gif")), lambda a: a["url"])
    one = lambda e: F.array(filled(e["video"]["url"]), *(F.when(_is_gif(filled(e[x]["url"])), e[x]["url"]) for x in ("image", "thumbnail")))
    return _joined(mine, F.flatten(F.transform(_c(embeds), one)))


def _joined(a: Column, b: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.filter(F.concat(F.coalesce(a, none), F.coalesce(b, none)), lambda u: u.isNotNull())
