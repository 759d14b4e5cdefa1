"""Main text of web pages by deducing each host's template.

Tokens of a page are its tags, told apart by their path, and its blocks of text, told apart by path
and content. A token's occurrence vector over the pages of its host is kept as a hash that is
combined on the map side, so no host's pages ever meet in one task; copies of a page count once.
Tokens of a host with the same vector form an equivalence class. A class is valid if it occurs on
`support` pages at least and holds a tag. Classes nest by their paths: what encloses a token occurs
on all of its pages too, so the class of an enclosing tag is valid if the token's is, up to the root.
Template text is what belongs to a valid class and stands on half of the host's pages at least.

The tags that occur once a page and on half of the pages at least cut the pages into slots. The main
slot is the innermost of them that holds most of the host's text. From a page's main slot (and the
article element around it, or those in it if they hold most of its text) everything is taken but
template text and what is marked as menu, advert, form, comments or the like. In articles, template
text must stand on `article_support` pages at least, as articles quote each other. The mark
of a class or id name is void where it would hide the story itself: if what it hides on a host varies
from page to page and is VOID times the unmarked text that pages don't share. Marks and article
elements alone decide on pages without a main slot.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimworks.llm import _store

_RAW = "script|style|noscript|template|textarea|title|iframe|svg|select|button|object|canvas|math|audio|video"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|\b(hidden)\b""")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img nobr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TREE = frozenset("html body div section article main nav header footer aside form ul ol dl table tbody thead tfoot tr td th blockquote figure figcaption details dialog menu center fieldset head".split())
_SKIP_TAGS = frozenset("head nav aside form dialog menu fieldset".split())
_OUTSIDE_ONLY = frozenset("header footer".split())
_SKIP_WORDS = frozenset("ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended trending sidebar widget widgets breadcrumb breadcrumbs menu menus nav navbar navigation pagination pager footer comment comments disqus replies respond toolbar search skip masthead byline".split())
_COMMENTS = frozenset("comment comments disqus replies respond".split())
_HEADER_WORDS = frozenset("header masthead byline".split())
VOID = 4  # how many times the unshared text a name's mark must hide to be void
_MARKS = {"skip": 0, "named": 5, "comments": 1}  # the fifths of a hidden text that count for that
_SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())


def _attributes(tag: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(tag)}


def _kind(name: str, tag: str, inside: bool) -> tuple[str, str]:
    """What an element is: 'skip', 'named' (to be skipped for its class or id), 'comments', 'article'
    or '', and its step of the path."""
    if "=" not in tag and "hidden" not in tag:
        attributes, words = {}, frozenset()
    else:
        attributes = _attributes(tag)
        words = frozenset(w for key in ("class", "id") for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", attributes.get(key, "")).lower()))
    step = name + "".join("." + c for c in re.sub(r"\d+", "", attributes.get("class", "")).split())
    if words & _COMMENTS:
        return "comments", step
    if name in ("article", "main") or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articleBody":
        return "article", step
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""))
    skipped = words & (_SKIP_WORDS - _HEADER_WORDS if inside else _SKIP_WORDS | {"header"})
    if name in ("html", "body"):
        return "", step
    if name in _SKIP_TAGS or (name in _OUTSIDE_ONLY and not (inside and name == "header")) or attributes.get("role") in _SKIP_ROLES or hidden:
        return "skip", step
    return "named" if skipped else "", step


def _crc(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def blocks(page: str) -> tuple[list[tuple[str, tuple[int, ...], int, dict[int, str]]], list[tuple[int, int]]]:
    """The blocks of a page in order, (text, hashes of the enclosing paths, that of the outermost
    article around it or 0, those of the marked elements around it with their kinds), and for each
    structural tag the hashes of its path and of the enclosing one. Markup, comments and raw
    elements are gone, references are decoded, white space is one space."""
    out: list[tuple[str, tuple[int, ...], int, dict[int, str]]] = []
    paths: list[tuple[int, int]] = []
    stack: list[tuple[str, str, str, int]] = []  # name, kind, path and its hash
    parts: list[str] = []

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                article = next((x[3] for x in stack if x[1] == "article"), 0)
                out.append((text, tuple(x[3] for x in stack), article, {x[3]: x[1] for x in stack if x[1] in _MARKS}))

    for m in _TOKEN.finditer(page):
        t = m[0]
        if t[0] != "<" or len(t) == 1:
            parts.append(t)
            continue
        if m[1]:
            if m[1].lower() in ("title", "select", "button", "textarea", "iframe", "video", "audio", "object"):
                flush()
            continue
        n = _NAME.match(t)
        if not n:
            continue
        name = n[1].lower()
        if name in _INLINE:
            continue
        flush()
        if name in _VOID or name not in _TREE:
            continue
        if t[1] == "/":
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                del stack[at:]
            continue
        kind, step = _kind(name, t, any(x[1] == "article" for x in stack))
        if kind == "article" and not any(x[1] == "comments" for x in stack) and name in ("article", "main"):
            while stack and any(x[1] in ("skip", "named") for x in stack) and not any(x[1] == "article" for x in stack):  # an unclosed menu or advert
                stack.pop()
        path = (stack[-1][2] if stack else "") + "/" + step
        paths.append((_crc(path), stack[-1][3] if stack else 0))
        stack.append((name, kind, path, paths[-1][0]))
    flush()
    return out, paths


def host(url: str | None) -> str:
    """The host of a URL in lower case, without port; '' if there is none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def tokens(pages: DataFrame) -> DataFrame:
    """host, token, is_tag, n (occurrences), depth (of a tag), chars (of unmarked text, within the tag
    or its own), hidden (of a marked tag: characters that its mark alone hides), content (a hash of
    what it hides), page (a hash of its html, the same for copies)."""

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(9)]
            for url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, key = host(url), _crc(page or "")
                found, paths = blocks(page or "")
                chars: dict[int, int] = {}
                count: dict[tuple[int, bool], int] = {}
                depth: dict[int, int] = {0: 0}
                for p, outer in paths:
                    count[p, True] = count.get((p, True), 0) + 1
                    depth[p] = depth[outer] + 1
                own: dict[int, int] = {}
                weight: dict[int, int] = {}
                hidden: dict[int, list[str]] = {}
                for text, within, _, marks in found:
                    k = _text_token(within, text)
                    count[k, False] = count.get((k, False), 0) + 1
                    if not marks:
                        own[k] = own.get(k, 0) + len(text)
                        for p in within:
                            chars[p] = chars.get(p, 0) + len(text)
                    elif len(marks) == 1:
                        (p, kind), = marks.items()
                        weight[p] = weight.get(p, 0) + len(text) * _MARKS[kind] // 5
                        hidden.setdefault(p, []).append(text)
                for (token, tag), n in count.items():
                    row = (depth.get(token, 0), chars.get(token, 0), weight.get(token, 0), _crc("\n".join(hidden.get(token, ())))) if tag else (0, own.get(token, 0), 0, 0)
                    for c, v in zip(columns, (name, token, tag, n, *row, key), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 6), strict=True)], ["host", "token", "is_tag", "n", "depth", "chars", "hidden", "content", "page"])

    return pages.select("url", "html").mapInArrow(run, "host string, token long, is_tag boolean, n long, depth long, chars long, hidden long, content long, page long")


def _text_token(within: tuple[int, ...], text: str) -> int:
    return _crc(f"{within[-1] if within else 0} {text}")


def template(pages: DataFrame, support: int = 2) -> DataFrame:
    """host, token, is_tag, class, pages, once, depth, chars, hidden, varies (whether what a mark hides
    does): the tokens of each host's template, with how many pages it has (all) and the text of its
    unmarked parts (whole)."""
    # Copies of a page count once: else a host of copies would be all template.
    found = tokens(pages).groupBy("host", "token", "page").agg(*[F.max(c).alias(c) for c in ("n", "is_tag", "depth", "chars", "hidden", "content")])
    each = found.groupBy("host", "token").agg(F.bit_xor(F.xxhash64("page", "n")).alias("class"), F.count("*").alias("pages"), F.max("is_tag").alias("is_tag"), (F.max("n") == 1).alias("once"), F.max("depth").alias("depth"), F.sum("chars").alias("chars"), F.sum("hidden").alias("hidden"), (F.min("content") != F.max("content")).alias("varies"))
    each = _store.table(each.filter(F.col("pages") >= support), "template-tokens")
    # A class of text is valid if it has the vector of a tag of its host; that of a tag always is.
    valid = each.filter("is_tag").groupBy("host", "class").agg(F.count("*").alias("tags"))
    size = each.filter("is_tag").groupBy("host").agg(F.max("pages").alias("all"), F.max("chars").alias("whole"))
    return each.join(valid, ["host", "class"], "left_semi").join(size, "host").filter("2 * pages >= all")


def _slot(found: list[tuple[str, tuple[int, ...], int, bool]], main: int) -> list[tuple[str, tuple[int, ...], int, bool]]:
    """The blocks of a page that belong to its main slot, with the article around it; on a page
    without it, those of its articles, if there are any, or all."""
    slot = [x for x in found if main in x[1]]
    if not slot:
        return [x for x in found if x[2]] if any(a and not s for _, _, a, s in found) else found
    around = {a for _, w, a, _ in slot if a and w.index(a) <= w.index(main)}
    if around:
        return [x for x in found if main in x[1] or x[2] in around]
    sizes = [(len(t), a) for t, _, a, s in slot if not s]
    return [x for x in slot if x[2]] if 2 * sum(n for n, a in sizes if a) > sum(n for n, _ in sizes) else slot


def extract(pages: DataFrame, support: int = 2, most_hosts: int = 20_000, article_support: int = 8) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars, n_blocks, template_blocks, one row
    per row of pages.

    A null or empty html has an empty text. Blocks are joined in page order by one space. Marked
    blocks are left out, unless their mark is void. So is template text, in articles if it stands on
    article_support pages, unless it is most of what a page would have (a page that holds nearly the
    same article as the others: its template can't be told from its text). A host with fewer than `support` different pages has no template; a
    page without a host shares one with the others without. Up to most_hosts hosts the templates are
    broadcast (their number of tokens a host is bounded by twice the blocks of a page); beyond that
    pages and templates are joined, where Spark can split a large host. Other columns are ignored.
    Repeated rows have the same text each. An empty table gives no rows.
    """
    known = template(pages, support)
    slot = F.col("is_tag") & F.col("once") & (2 * F.col("chars") > F.col("whole"))
    text = ~F.col("is_tag")
    hosts = known.groupBy("host").agg(
        F.max(F.when(slot, F.struct("depth", "token"))).alias("main"),
        F.max(F.when(F.col("is_tag") & F.col("once") & F.col("varies"), F.struct("hidden", "token"))).alias("hides"),
        F.collect_set(F.when(text, F.col("token"))).alias("drop"),  # each on half of the pages, so at most two pages' blocks
        F.collect_set(F.when(text & (F.col("pages") >= article_support), F.col("token"))).alias("firm"),
        (F.max("whole") - F.coalesce(F.sum(F.when(text, F.col("chars"))), F.lit(0))).alias("unshared"),
    )
    void = F.when((F.col("hides.hidden") > 0) & (F.col("hides.hidden") > VOID * F.col("unshared")), F.col("hides.token"))
    hosts = hosts.select(F.col("host").alias("h"), F.coalesce(void, "main.token", F.lit(0)).alias("main"), F.coalesce(void, F.lit(0)).alias("void"), "drop", "firm")
    hosts = _store.table(hosts, "templates")
    size = hosts.agg(F.sum(F.size("drop")).alias("n"), F.count("*").alias("hosts")).first()
    rows = pages.select("page_id", "url", "html")

    def run(template_of):
        def each(batches):
            for batch in batches:
                out: list[list] = [[] for _ in range(4)]
                for page, (main, void, drop, firm) in zip(batch.column(2).to_pylist(), template_of(batch), strict=True):
                    found = [(t, w, a, any(m != void for m in marks)) for t, w, a, marks in blocks(page or "")[0]]
                    inside = [(t, _text_token(w, t) in (firm if a else drop)) for t, w, a, s in _slot(found, main) if not s]
                    fixed = sum(len(t) for t, f in inside if f)
                    if 2 * fixed > sum(len(t) for t, _ in inside):
                        inside = [(t, False) for t, _ in inside]
                    kept = [t for t, f in inside if not f]
                    text = " ".join(kept)
                    for c, v in zip(out, (text, len(text), len(kept), len(inside) - len(kept)), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.string()), *(pa.array(c, pa.int64()) for c in out[1:])], ["page_id", "url", "text", "n_chars", "n_blocks", "template_blocks"])

        return each

    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long").add("n_blocks", "long").add("template_blocks", "long")
    none = (0, 0, frozenset(), frozenset())
    if size["hosts"] <= most_hosts and (size["n"] or 0) <= 50 * most_hosts:
        shared = rows.sparkSession.sparkContext.broadcast({r["h"]: (r["main"], r["void"], frozenset(r["drop"]), frozenset(r["firm"])) for r in hosts.collect()})
        return rows.mapInArrow(run(lambda batch: [shared.value.get(host(u), none) for u in batch.column(1).to_pylist()]), schema)
    named = _hosts(rows)
    joined = named.join(hosts, named["host"] == hosts["h"], "left").select("page_id", "url", "html", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("main", "void")], "drop", "firm")
    return joined.mapInArrow(run(lambda batch: [(m, v, frozenset(d or ()), frozenset(f or ())) for m, v, d, f in zip(*(batch.column(c).to_pylist() for c in range(3, 7)), strict=True)]), schema)


def _hosts(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host(u) for u in batch.column(1).to_pylist()], pa.string())], ["page_id", "url", "html", "host"])

    return rows.mapInArrow(run, rows.select("page_id", "url", "html").schema.add("host", "string"))
