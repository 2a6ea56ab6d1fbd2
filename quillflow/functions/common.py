"""Matchers that many configurations need: groups of content types, and fields that say where a document is from."""

from __future__ import annotations

from ..functions.matcher import TextMatcher, csv

DOM = (
    "text/html", "text/xml", "application/xhtml+xml", "application/xml", "application/rss+xml", "application/atom+xml", "image/svg+xml",
    "application/vnd.wap.xhtml+xml", "application/x-asp", "application/xslt+xml", "application/mathml+xml",
)
HTML = ("text/html", "application/xhtml+xml", "application/vnd.wap.xhtml+xml", "application/x-asp")
FEED = ("application/rss+xml", "application/rdf+xml", "application/atom+xml", "application/xml", "text/xml")
XML = ("application/xml", "text/xml", "application/xslt+xml", "application/rss+xml", "application/atom+xml", "application/mathml+xml", "image/svg+xml", "application/xhtml+xml")
IMAGE = ("image/png", "image/jpeg", "image/gif", "image/bmp", "image/tiff", "image/webp", "image/vnd.wap.wbmp", "image/x-windows-bmp")
CSV = ("text/csv", "text/tab-separated-values", "application/csv")


def types(*of: tuple[str, ...]) -> TextMatcher:
    """A matcher of the content types of some groups, whatever their case."""
    return csv(",".join(dict.fromkeys(t for group in of for t in group)), ignore_case=True)
