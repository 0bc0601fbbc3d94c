"""HTML extraction with removal of site templates.

Every element's subtree is hashed: tag, attributes and, in order, texts and
children. Spark counts on how many distinct pages of a host each subtree occurs.
A subtree is part of the site's template if that is at least MIN_PAGES pages and,
of the host's distinct pages,

  - a share of SHARE for containers (nav, header, footer, aside, div, lists ...),
    since a host may have many templates, each on few of its pages;
  - a share of BLOCK_SHARE for blocks of text (p, h1 to h6, li, pre ...), which recur
    on some pages as content does;

inline elements, cells and rows of tables go with what they are in, never alone.
Each page's text is then extracted without the template, wherever in the page it
is. html, head and body are structure and never deleted as a whole.

Pages are parsed where they lie, once to count and once to extract. What is shuffled
is one array of hashes for each distinct page and one (host, hash) pair of 16 bytes
for each subtree, partially counted before. Templates reach the pages by host,
broadcast only if measured to be few; otherwise pages and templates are joined by
host, and adaptive execution splits the pages of a large host.

Defined results: a null html has a null text, an empty one an empty text; pages
with a null or hostless url belong to no site and lose nothing; copies of a page
on one host, under any id or url, count as one page, and each has its row;
subtrees that tie at a threshold are deleted; very long and deep pages take time
in proportion to their length; an empty table has no rows; extra columns, whatever
their names, aren't carried along; unclosed and misnested tags close as browsers
close them in the common cases; comments, scripts and styles are never text.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_PAGES, SHARE, BLOCK_SHARE = 5, 0.01, 0.5

_TAG = re.compile(r"""<!--|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*+)>""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(f"</{t}[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "svg")}
_NO_TEXT = frozenset("script style head title noscript template svg".split())
_STRUCTURE = frozenset("html head body".split())
_BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul br".split())
#: What may be deleted by SHARE, and what only by BLOCK_SHARE.
_CONTAINERS = frozenset("article aside details div dl fieldset figure footer form header iframe main menu nav noscript object ol script section select style svg table template ul".split())
_TEXTS = frozenset("address blockquote button figcaption h1 h2 h3 h4 h5 h6 label legend li p pre summary".split())
_CLOSES_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "body", "html", "dd", "dt", "li"}
#: Open elements of a scope that an opening tag closes.
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}} | dict.fromkeys(_CLOSES_P, {"p"})
_BARRIER = frozenset("table ul ol dl select body html article section div".split())


@dataclass
class _Node:
    tag: str
    at: int
    parts: list[str] = field(default_factory=list)
    hash: int = 0
    end: int = 0


def parse(page: str) -> tuple[list[tuple[str, object]], list[_Node]]:
    """Tokens ("text", string), ("open", node), ("close", node) in order, and all nodes."""
    tokens: list[tuple[str, object]] = []
    nodes: list[_Node] = []
    root = _Node("", 0)
    stack = [root]
    #: open elements by tag: of the page, and of each scope that a barrier begins, so that no tag searches the stack
    everywhere: dict[str, int] = {}
    scopes: list[dict[str, int]] = [{}]

    def close() -> None:
        node = stack.pop()
        node.hash = xxhash.xxh3_64_intdigest("\x1f".join(node.parts)) >> 1
        stack[-1].parts.append(f"#{node.hash:x}")
        tokens.append(("close", node))
        node.end = len(tokens)
        everywhere[node.tag] -= 1
        if node.tag in _BARRIER:
            scopes.pop()
        else:
            scopes[-1][node.tag] -= 1

    def text(s: str) -> None:
        if s and not s.isspace():
            stack[-1].parts.append(" ".join(s.split()))
            tokens.append(("text", s))
        elif s:
            tokens.append(("text", " "))

    pos, size = 0, len(page)
    while pos < size:
        m = _TAG.search(page, pos)
        if m is None:
            text(page[pos:])
            break
        text(page[pos : m.start()])
        pos = m.end()
        tag = m[2] or m[5]
        if tag is None:
            end = page.find("-->" if m[0] == "<!--" else ">", pos)
            pos = size if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if everywhere.get(tag):
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        for t in _SAME.get(tag, ()):
            while scopes[-1].get(t):
                close()
        attributes = m[3] if m[2] else m[6]
        node = _Node(tag, len(tokens), [tag, " ".join(attributes.strip(" /\n\t").split()) if attributes else ""])
        nodes.append(node)
        tokens.append(("open", node))
        stack.append(node)
        everywhere[tag] = everywhere.get(tag, 0) + 1
        if tag in _BARRIER:
            scopes.append({})
        else:
            scopes[-1][tag] = scopes[-1].get(tag, 0) + 1
        if tag in _VOID:
            close()
        elif tag in _RAW:
            end = _RAW[tag].search(page, pos)
            text(page[pos : end.start() if end else size])
            pos = end.end() if end else size
            close()
    while len(stack) > 1:
        close()
    return tokens, nodes


def subtrees(page: str) -> list[int]:
    """Distinct hashes of the subtrees that may be deleted; the last bit is set for blocks of text."""
    return list({key for n in parse(page)[1] if (key := _key(n)) is not None})


def _key(node: _Node) -> int | None:
    if node.tag in _CONTAINERS:
        return node.hash & ~1
    return node.hash | 1 if node.tag in _TEXTS else None


def extract(page: str, drop: frozenset[int] | set[int]) -> tuple[str, int]:
    """The text of a page without the dropped subtrees, one line a block, and how many were dropped."""
    tokens, _ = parse(page)
    lines: list[str] = []
    line: list[str] = []
    k = removed = 0
    while k < len(tokens):
        kind, x = tokens[k]
        k += 1
        if kind == "text":
            line.append(x)
            continue
        if kind == "open" and _key(x) in drop:
            removed += 1
            k = x.end
        elif kind == "open" and x.tag in _NO_TEXT:
            k = x.end
        if x.tag in _BLOCK and line:
            lines.append("".join(line))
            line = []
    lines.append("".join(line))
    clean = (" ".join(entities.unescape(s).split()) for s in lines)
    return "\n".join(s for s in clean if s), removed


@F.arrow_udf(T.ArrayType(T.LongType()))
def _subtrees(pages: pa.Array) -> pa.Array:
    return pa.array([None if p is None else subtrees(p) for p in pages.to_pylist()], pa.list_(pa.int64()))


@F.arrow_udf(T.StructType().add("text", T.StringType()).add("removed", T.LongType()))
def _extract(pages: pa.Array, hosts: pa.Array, drops: pa.Array) -> pa.Array:
    if isinstance(drops, pa.ChunkedArray):
        drops = drops.combine_chunks()
    sets: dict[int | None, frozenset[int]] = {}
    out = []
    for k, (p, host) in enumerate(zip(pages.to_pylist(), hosts.to_pylist())):
        if host not in sets:  # all pages of a host have the same templates
            sets[host] = frozenset(drops[k].as_py() or ())
        out.append(None if p is None else dict(zip(("text", "removed"), extract(p, sets[host]))))
    return pa.array(out, pa.struct([("text", pa.string()), ("removed", pa.int64())]))


def templates(pages: DataFrame, scratch: common.Scratch, min_pages: int = MIN_PAGES, share: float = SHARE, block_share: float = BLOCK_SHARE) -> DataFrame:
    """(host, drop): the hashes of each host's template subtrees. pages: host, html."""
    each = pages.where("host is not null and html is not null").select(F.xxhash64("host").alias("host"), F.xxhash64("html", F.length("html")).alias("page"), _subtrees("html").alias("h"))
    # one row of each distinct page, by host and page, so that a large host is spread
    each = each.dropDuplicates(["host", "page"])
    each = each.select("host", F.explode(F.concat("h", F.array(F.lit(-1).cast("long")))).alias("hash"))
    n = each.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    n = scratch.stored(n, "subtrees")
    hosts = n.where("hash = -1").select("host", F.col("n").alias("pages"))
    least = F.when(F.col("hash") % 2 == 0, F.lit(share)).otherwise(F.lit(block_share))
    many = n.where("hash <> -1").join(hosts, "host").where(F.col("n") >= F.col("pages") * least)
    return many.groupBy("host").agg(F.collect_list("hash").alias("drop"))


def extracted(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, block_share: float = BLOCK_SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, text, removed) of each page."""
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    base = pages.select(F.col(id_col).alias("page_id"), F.nullif(host, F.lit("")).alias("host"), F.col(html_col).alias("html"))
    scratch = common.Scratch()
    t = common.stored(templates(base, scratch, min_pages, share, block_share), "templates")
    scratch.clear()
    rows, hashes = t.agg(F.count("*"), F.coalesce(F.sum(F.size("drop")), F.lit(0))).first()
    key = F.when(F.col("host").isNotNull(), F.xxhash64("host"))
    rows = base.withColumn("k", key).join(common.small(t.toDF("k", "all"), 1, 64 * rows + 8 * hashes), "k", "left")
    return rows.select("page_id", _extract("html", "k", "all").alias("x")).select("page_id", "x.text", F.coalesce("x.removed", F.lit(0).cast("long")).alias("removed"))
