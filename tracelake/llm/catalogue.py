"""All queries of the text operators."""

from . import decontaminate, html, language, license, lines, mixing, quality, repair, simhash, topk, trie, urls, warc  # noqa: F401
from .common import CHECKS, QUERIES  # noqa: F401
