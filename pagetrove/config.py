"""Job parameters and the fixed lists the jobs share."""

from __future__ import annotations

from dataclasses import dataclass

# A link is skipped when its address contains any of these.
LINK_DENY_LIST = (
    ".txt", ".doc", ".docx", ".pdf", ".odt", ".ods", ".odp", ".epub", ".xls", ".xlsx",
    ".ppt", ".pptx", ".jpg", ".jpeg", ".png", ".bmp", ".svg", ".gif", ".mp3", ".mp4",
    ".avi", ".mkv", ".mov", ".wmv", ".flv", ".wav", ".ogg", ".webm", ".zip", ".rar",
    ".7z", ".tar.gz", ".tar.xz", ".tar.bz2", ".tar.lz", ".tar.lzma", ".tar.Z", ".tar.sz",
    ".tar.zst", ".iso", ".dmg", ".css", ".js", ".exe", ".dll", ".tar", ".json", ".ini",
    ".tmp", ".swp", "/wp-admin/", "/login", "/register", "/cgi-bin/", "/wp-admin/",
    "/wp-content/", "/wp-includes/", "/admin/", "/signin", "/signup",
)


@dataclass(frozen=True)
class IngestConfig:
    chunk_size: int = 1000
    min_tail: int = 5            # a last chunk of this many characters or fewer is dropped
    dims: int = 384
    block_breaks: bool = True    # block-level end tags separate paragraphs
    normalize: str = "first"     # "first": one tab and one double space per paragraph; "all"
    drop_empty: bool = False     # keep the empty chunk a long first paragraph produces
    article: str = "tags"        # by article, main and body elements; "dense": the run of blocks with most text beside links
    sitename: str = "host"       # or "article": the page's own og:site_name


@dataclass(frozen=True)
class SearchConfig:
    max_results: int = 100
    per_page: int = 30
    metric: str = "cosine"       # or "dot", "euclidean"


# Weights of the ranking rules.
@dataclass(frozen=True)
class RankWeights:
    fuzzy_cutoff: int = 80
    url_match: float = 0.1
    title_match: float = 0.1
    summary_match: float = 0.2
    query_or_fragment: float = 0.1
    long_title: float = 0.05
    long_title_chars: int = 50
    repeat_url: float = 0.1
    no_matching_line: float = 0.05
    matching_line: float = 0.01
    min_line_chars: int = 10
    snippet_chars: int = 50
    short_summary_chars: int = 20
    no_summary: float = 0.2
