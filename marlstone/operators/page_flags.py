"""Predicates on landed pages: walls, gates, bounces, captchas, blocks, usable result pages; and on categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hints of a wall.
WALL_HINTS = ["captcha", "cloudflare", "ddos", "are you human", "not a bot", "i'm not a robot"]
# Hints of a waiting room or of a demand for scripts.
GATE_HINTS = ["access queue", "you have been placed in a queue", "estimated wait", "please wait", "just a moment", "one moment", "redirected", "ddos", "captcha", "cloudflare", "enable javascript"]
# Words of a captcha page.
CAPTCHA_WORDS = ["captcha", "verify you are human", "cloudflare", "ddos-guard", "are you human"]
# Words of a page that asks for a new identity.
BLOCK_WORDS = ["ddos protection", "new tor identity", "kill switch"]
# Words of a forum page's title that is itself the challenge.
FORUM_CHALLENGES = ["captcha", "ddos", "just a moment", "checking your browser"]
# Words that make a category relevant.
RELEVANT_WORDS = ["pharmacy", "pharma", "prescription", "rx", "health", "pill", "medicine", "medication", "drug", "hormone", "fertility", "women", "contracept", "abortion", "birth control", "sexual", "steroid"]
# Words by which a page without links looks blocked.
EMPTY_PAGE_WORDS = ["captcha", "verify you", "cloudflare", "challenge", "ddos", "rate limit", "too many"]


def any_of(text: Column, phrases: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def _html(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def title(html: Column) -> Column:
    """The first title element's text, '' without one."""
    return F.trim(F.regexp_extract(_html(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_text(html: Column) -> Column:
    """A page's text: scripts, styles, templates, comments and tags as one blank each; null as ''."""
    t = F.regexp_replace(_html(html), r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "<x>")
    return F.trim(F.regexp_replace(t, r"\s*(?:<[^>]*>\s*)+", " "))


def anchors(html: Column) -> Column:
    """Number of links with an address."""
    return F.size(F.regexp_extract_all(_html(html), F.lit(r"(?i)<a\s[^>]*?\bhref\s*="), F.lit(0)))


def walled(status: Column, html: Column) -> Column:
    """401 or 403, or a short page that hints at a wall."""
    return F.coalesce(status, F.lit(0)).isin(401, 403) | ((F.length(_html(html)) < 4000) & any_of(html, WALL_HINTS))


def gated(status: Column, html: Column) -> Column:
    """Walled, or at most two links and a text that hints at a gate; an empty page is not gated."""
    return walled(status, html) | ((_html(html) != "") & (anchors(html) <= 2) & any_of(page_text(html), GATE_HINTS))


def bounce(html: Column) -> Column:
    """A short page that refreshes."""
    h = _html(html)
    return (F.length(h) < 400) & h.rlike(r"""(?i)http-equiv=["']?refresh["']?[^>]*url=/?["']?\s*/?\s*["']?""")


def captcha(html: Column) -> Column:
    return any_of(html, CAPTCHA_WORDS)


def identity_block(html: Column) -> Column:
    """A block that a new identity would lift."""
    return any_of(html, BLOCK_WORDS)


def forum_block(html: Column) -> Column:
    """Short and empty pages, and pages whose head up to the title's end is a challenge."""
    h = _html(html)
    low = F.lower(h)
    return (F.length(h) < 500) | (F.contains(low, F.lit("<title")) & any_of(F.substring_index(low, "</title>", 1), FORUM_CHALLENGES))


def usable_results(html: Column, marker: Column | None = None) -> Column:
    """A long page without a captcha that holds the site's marker, if the site has one; letter case doesn't count."""
    ok = (F.length(_html(html)) >= 1000) & ~captcha(html)
    return ok if marker is None else ok & (F.coalesce(marker, F.lit("")) == "") | ok & F.contains(F.lower(_html(html)), F.lower(F.coalesce(marker, F.lit(""))))


def looks_blocked(html: Column) -> Column:
    """Whether a page without product links looks blocked."""
    return any_of(html, EMPTY_PAGE_WORDS)


def relevant(url: Column, name: Column) -> Column:
    return any_of(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(name, F.lit(""))), RELEVANT_WORDS)
