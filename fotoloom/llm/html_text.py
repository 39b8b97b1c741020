"""Main text of web pages: a suffix array over all pages of a host, then markup for what a page says by itself.

1. Each page becomes blocks of three kinds, all of which are in the array.  Scripts and styles are no text.
   *Left out* are menus, headers, footers, sidebars, forms, adverts, notices and comments by element, role
   and class names, and what stands outside a declared article.  *Declared* are the blocks of an article
   (``article``, or a role or class that says so; ``main`` where there is no article in it).  *Undecided* are
   all other blocks: those of pages that declare nothing, and those of ``main`` beside an article.
2. The suffix array of a host: suffixes of all kinds of blocks are rows with their first ``DEPTH`` tokens,
   which are dealt out by the first ``RUN`` of them, sorted, and compared with their neighbours.  The
   common prefix that a suffix has with those of ``PAGES`` - 1 other pages is a string repeated across pages; if it
   has ``RUN`` tokens or more it is boilerplate.  What is longer than DEPTH is covered by the suffixes that
   start inside.
3. Undecided blocks lose the tokens that such strings cover.  A menu that one page has without any mark is
   known by the marked menus of others, and a passage by the articles that have it.  Declared and left out
   blocks are witnesses only: an article is kept whole although a host may repeat it, and an advert goes
   although no other page has it.

Before the sort, suffixes that can't have a part in such a string are set aside.  Of the ``GRAM``-token strings in
each RUN tokens one is chosen by its hash, so equal runs choose equal ones; if fewer than PAGES pages of the host
have it, the run is not repeated.  Hashes that enough pages have go into a filter of at most ``SLICES`` x 128 KB.
False hits of the filter only add rows to the sort.

Copies of one page count as one page, whatever is left out of them: a page is known by its other blocks.  A string that
many pages have is one run of sorted rows, which a task reads as a stream and never holds.
Null html is empty; nothing is dropped or capped inside the text.  Repeated rows give equal rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions_for, small_batches, written

RUN = 8
DEPTH = 16
PAGES = 3
GRAM = 4
#: An anchor is the hash of a chosen string, and below it TAG_BITS bits of its page.
TAG_BITS = 28
SLICES = 256
_SLICE_BITS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)

LEFT, DECLARED, UNDECIDED = 0, 1, 2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Element names of HTML by what they mean here.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp"}
LEFT_OUT = {"nav", "footer", "aside", "form", "head", "svg", "object", "button", "select", "menu", "dialog", "canvas", "audio", "video", "map", "datalist", "fieldset"}
RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "aside", "caption",
}
ROLES_OUT = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "note"}
NAMES_OUT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adbox|adsense|banner|sponsor(?:ed)?|promo(?:tion)?s?|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|"
    r"comments?|commentlist|disqus|replies|respond|sidebar|side-bar|sidenav|menu|navbar|navigation|nav|breadcrumbs?|topbar|footer|header|masthead|share|sharing|social|related|recommended|"
    r"newsletter|subscribe|subscription|signup|login|search|widgets?|pagination|pager|skip-link|toc|tags?-list|hidden)(?:$|[\s_-])",
    re.I,
)
NAMES_MAIN = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main)(?:[\s_-]?(?:body|content|text))(?:$|[\s_-])", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CLOSED_BY_P = {"p"}
HOLDERS = {"div", "article", "main", "section", "td", "li", "blockquote"}


@lru_cache(maxsize=4096)
def _says_again(name: str, raw: str) -> tuple[bool, int]:
    """As ``_says``, for short tags, which come again on page after page."""
    return _says(name, raw)


def _says(name: str, raw: str) -> tuple[bool, int]:
    """(left out, 2 where it declares the article, 1 where it declares the main part) for an opening tag."""
    if name in LEFT_OUT:
        return True, 0
    attributes = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}
    role = attributes.get("role", "").lower()
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    by_names = NAMES_MAIN.search(names) if names.strip() else None
    article = name == "article" or role == "article" or attributes.get("itemprop", "").lower() == "articlebody" or bool(by_names and not by_names[0].strip(" _-").lower().startswith("main"))
    main = name == "main" or role == "main" or bool(by_names)
    if role in ROLES_OUT or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return True, 0
    if names.strip() and name not in ("body", "html", "main") and NAMES_OUT.search(names) and not (name == "article" and not re.search(r"comment|related|ad(?:$|[\s_-])|promo|teaser", names, re.I)):
        return True, 0
    return False, 2 if article else int(main)


def blocks(page: str | None) -> tuple[list[str], bool]:
    """Texts of the page's blocks before the array, and whether they are those of a declared article."""
    texts, kinds, _ = parts_of(page)
    return texts, DECLARED in kinds


def parts_of(page: str | None) -> tuple[list[str], list[int], str]:
    """Blocks that may be text, whether each is declared or undecided, and all that is left out.

    Where class names would leave nothing, as a wrapper's name speaks of a sidebar, elements alone decide.
    """
    found = _scan(page or "", True)
    return found if found[0] else _scan(page or "", False)


def _scan(page: str, by_name: bool) -> tuple[list[str], list[int], str]:
    found: list[tuple[str, int]] = []  # block, 2 in an article, 1 in a main part, 0 elsewhere
    lost: list[str] = []
    pieces: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # (element, left out, what it declares)
    open_at: dict[str, list[int]] = {}  # where in the stack the elements of a name, of blocks, ... are
    blocks_at: list[int] = []
    holders_at: list[int] = []
    out_at: list[int] = []
    out = inside = exact = 0
    at = 0

    def flush() -> None:
        if not pieces:
            return
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            found.append((text, 2 if exact else 1 if inside else 0))

    def close(index: int) -> None:
        nonlocal out, inside, exact
        while len(stack) > index:
            k = len(stack) - 1
            name, was_out, was_main = stack.pop()
            out -= was_out
            inside -= was_main > 0
            exact -= was_main == 2
            open_at[name].pop()
            for places in (blocks_at, holders_at, out_at):
                if places and places[-1] == k:
                    places.pop()

    def last(name: str) -> int:
        return open_at[name][-1] if open_at.get(name) else -1

    def within(places: list[int], k: int) -> bool:
        return bool(places) and places[-1] > k

    last_close: dict[str, int] = {}
    for m in re.finditer(r"</([a-zA-Z][a-zA-Z0-9:-]*)", page):
        last_close[m[1].lower()] = m.start()
    last_main = max((m.start() for m in re.finditer(r"<(?:article|main)\b", page, re.I)), default=-1)
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            (lost if out else pieces).append(entities.unescape(text))
        if not m:
            break
        at = m.end()
        end_a, name_a, raw_a, end_b, name_b, raw_b = m.groups()
        name = (name_a or name_b or "").lower()
        if not name:
            continue
        ending, raw, is_block = bool(end_a or end_b), raw_a or raw_b or "", name in BLOCKS
        if is_block and not out:
            flush()
        if out and (is_block or name in VOID or name in LEFT_OUT):
            lost.append(" ")
        if ending:
            k = last(name)
            if k >= 0:
                # a stray end of an inline element doesn't end the blocks that opened after it
                if is_block or name in LEFT_OUT or not within(blocks_at, k):
                    close(k)
            continue
        if name in RAW:
            end = RAW_ENDS[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            if not out:
                pieces.append(" ")
            continue
        if not is_block and raw.endswith("/"):
            continue
        if is_block and stack and stack[-1][0] in _CLOSED_BY_P:
            close(len(stack) - 1)
        elif is_block and name != "p":
            k = last("p")
            if k >= 0 and not within(holders_at, k):
                close(k)
        elif name == "p":
            k = last("p")
            if k >= 0 and not within(blocks_at, k):
                close(k)
        left_out, is_main = _says_again(name, raw) if len(raw) < 100 else _says(name, raw)
        if left_out and name not in LEFT_OUT and not inside and (not by_name or at <= last_main):
            left_out = False  # what holds the article isn't left out for its name
        if name == "header":
            left_out = not inside  # the head of an article holds its title
        if left_out and last_close.get(name, -1) < at and name != "p":
            left_out = False  # it never ends: leaving it out would take the rest of the page
        if is_main and out and name in ("article", "main"):
            k = out_at[0]
            if last_close.get(stack[k][0], -1) < at:
                close(k)
        k = len(stack)
        open_at.setdefault(name, []).append(k)
        if is_block:
            blocks_at.append(k)
        if name in HOLDERS:
            holders_at.append(k)
        if left_out:
            out_at.append(k)
        stack.append((name, left_out, is_main if not left_out and not out else 0))
        if left_out:
            lost.append(" ")
        out += left_out
        inside += stack[-1][2] > 0
        exact += stack[-1][2] == 2
    if not out:
        flush()
    most = max((level for _, level in found), default=0)
    kept = [(t, DECLARED if level and level == most else UNDECIDED) for t, level in found if level or not most]
    rest = [t for t, level in found if most and not level]
    return [t for t, _ in kept], [kind for _, kind in kept], " ".join(" ".join(["".join(lost), *rest]).split())


def host(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(host(u), *parts_of(h)) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        columns = [
            pa.array([r[0] for r in rows], pa.string()),
            pa.array([r[1] for r in rows], pa.list_(pa.string())),
            pa.array([r[2] for r in rows], pa.list_(pa.int8())),
            pa.array([r[3] for r in rows], pa.string()),
            pa.array([_page_id(*_segments(*r[1:])) for r in rows], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["page_id", "url", "host", "blocks", "kinds", "rest", "stream"])


def _stream(parts: list[str]) -> list[bytes]:
    return [t for p in parts for t in p.encode("utf-8", "replace").split()]


def _segments(texts: list[str], kinds: list[int], rest: str) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Tokens of the undecided, declared and left out blocks; no string of the array goes from one to another."""
    return _stream([t for t, k in zip(texts, kinds, strict=True) if k == UNDECIDED]), _stream([t for t, k in zip(texts, kinds, strict=True) if k == DECLARED]), _stream([rest])


def _page_id(undecided: list[bytes], declared: list[bytes], rest: list[bytes]) -> int:
    """Pages that differ in what is left out only are one."""
    return xxhash.xxh3_64_intdigest(b" ".join([*undecided, b"\n", *declared])) >> 1


def _chosen(names: list[str], runs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the token runs of hosts, end to end: the numbers of all tokens (4 bytes), where RUN tokens of one run start, and the hashes of the strings of GRAM tokens chosen in those."""
    sizes = np.array([len(r) for r in runs], dtype=np.int64)
    whole = np.frombuffer(b"".join([xxhash.xxh3_64_digest(t) for r in runs for t in r]), dtype=">u8").astype(np.uint64)
    numbers = (whole >> np.uint64(32)).astype(">u4")
    if len(whole) < RUN:
        return numbers, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    own = {name: xxhash.xxh3_64_intdigest(name.encode("utf-8", "replace")) for name in set(names)}
    gram = np.repeat(np.array([own[name] for name in names], dtype=np.uint64), sizes)[: len(whole) - GRAM + 1]
    for k in range(GRAM):
        gram = (gram ^ whole[k : len(gram) + k]) * _MIX
        gram ^= gram >> np.uint64(29)
    least = gram[: len(whole) - RUN + 1]
    for k in range(1, RUN - GRAM + 1):
        least = np.minimum(least, gram[k : k + len(least)])
    ends = np.repeat(np.cumsum(sizes), sizes)
    starts = np.flatnonzero(np.arange(len(least)) + RUN <= ends[: len(least)])
    # the least hash of some is small, so the bits that are kept are mixed once more
    return numbers, starts, (least[starts] * _MIX) >> np.uint64(TAG_BITS + 1)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every page the hashes of its chosen strings, each with a tag of the page."""
    for batch in batches:
        names, runs, tags = [], [], []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            segments = _segments(*parts_of(page))
            tag = _page_id(*segments) & ((1 << TAG_BITS) - 1)
            names += [host(url)] * 3
            tags += [tag] * 3
            runs += segments
        _, starts, hashes = _chosen(names, runs)
        own = np.repeat(np.array(tags, dtype=np.uint64), [len(r) for r in runs])[starts]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique((hashes << np.uint64(TAG_BITS)) | own).astype(np.int64), pa.int64())], ["anchor"])


def _shared_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted anchors the hashes that PAGES pages or more have."""
    held = np.zeros(0, dtype=np.int64)  # the last hash's anchors, PAGES at most
    for batch in batches:
        anchors = np.unique(np.concatenate([held, batch.column(0).to_numpy(zero_copy_only=False)]))
        hashes, starts, counts = np.unique(anchors >> TAG_BITS, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(hashes[counts >= PAGES], pa.int64())], ["hash"])
        held = anchors[starts[-1] :][-PAGES:] if len(starts) else held


def _places(hashes: np.ndarray, slices: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The slice of the filter that a hash belongs to, and its places there."""
    more = hashes.astype(np.uint64) // np.uint64(slices)
    return hashes.astype(np.uint64) % np.uint64(slices), [(more * np.uint64(k) * _MIX) >> np.uint64(44) for k in (1, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)]


def _filter(shared: DataFrame) -> list[bytes]:
    """Slices of bits in which the places of all given hashes are set: 16 bits a hash, until there are SLICES of them."""
    n = shared.count()
    slices = max(1, min(SLICES, -(-16 * n // _SLICE_BITS)))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            which, places = _places(batch.column(0).to_numpy(zero_copy_only=False), slices)
            for k in np.unique(which).tolist():
                mine = own.setdefault(k, np.zeros(_SLICE_BITS, dtype=bool))
                for p in places:
                    mine[p[which == k]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([np.packbits(x).tobytes() for x in own.values()], pa.binary())], ["slice", "bits"])

    made = {r["slice"]: bytes(r["bits"]) for r in shared.repartition(min(slices, partitions_for(shared)), F.col("hash") % slices).mapInArrow(bits, "slice int, bits binary").collect()}  # 32 MB at most
    return [made.get(k, bytes(_SLICE_BITS // 8)) for k in range(slices)]


def _suffixes(slices):  # noqa: ANN001, ANN202
    """Suffixes that may start a repeated string: host, the numbers of its first DEPTH tokens (4 bytes each), page and start.

    Starts are those of undecided blocks; witnesses have -1.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(b"".join(slices.value), dtype=np.uint8)
        for batch in batches:
            names, runs, pages = [], [], []
            for name, texts, kinds, rest, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names += [name] * 3
                runs += _segments(texts, kinds, rest)
                pages += [page] * 3
            numbers, starts, hashes = _chosen(names, runs)
            which, places = _places(hashes, len(slices.value))
            hit = np.ones(len(hashes), dtype=bool)
            for p in places:
                hit &= (bits[which * np.uint64(_SLICE_BITS // 8) + (p >> np.uint64(3))] >> (7 - (p & np.uint64(7)).astype(np.uint8))) & 1 == 1
            starts = starts[hit]
            ends = np.cumsum([len(r) for r in runs])
            run = np.searchsorted(ends, starts, side="right")
            lengths = np.minimum(DEPTH, ends[run] - starts)
            bytes_ = numbers.tobytes()
            seen: set[bytes] = set()  # heads of this page's witnesses
            out: tuple[list, list, list, list] = ([], [], [], [])
            last = -1
            for s, n, k in zip(starts.tolist(), lengths.tolist(), run.tolist(), strict=True):
                head, at = bytes_[4 * s : 4 * (s + n)], -1
                if k // 3 != last:
                    last = k // 3
                    seen.clear()
                if k % 3:  # a string that a page repeats is one witness
                    if head in seen:
                        continue
                    seen.add(head)
                else:
                    at = s - int(ends[k]) + len(runs[k])
                for column, value in zip(out, (names[k], head, pages[k], at), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.binary(), pa.int64(), pa.int32()), strict=True)], ["host", "head", "stream", "at"])

    return rows


def common_prefix(a: bytes, b: bytes) -> int:
    """Tokens of 4 bytes that two heads have in common at their start."""
    n = min(len(a), len(b)) // 4
    return next((k for k in range(n) if a[4 * k : 4 * k + 4] != b[4 * k : 4 * k + 4]), n)


def shared_lengths(rows: list[tuple], before: list[list], after: list[list]) -> list[int]:
    """For each sorted row (host, head, stream, at) the tokens that it shares with PAGES - 1 other streams.

    before and after have, for each row, the nearest suffixes of other streams as [stream, tokens in
    common], each of another stream, nearest first.
    """
    out = []
    for left, right in zip(before, after, strict=True):
        # PAGES - 1 neighbours, some from the left and the rest from the right; a stream counts once
        best = 0
        for k in range(PAGES):
            some = left[:k]
            known = {x[0] for x in some}
            more = [x for x in right if x[0] not in known][: PAGES - 1 - k]
            if len(some) == k and len(some) + len(more) == PAGES - 1:
                best = max(best, min(x[1] for x in some + more))
        out.append(best)
    return out


def _neighbours(rows: list[tuple]) -> list[list]:
    """For each row the last PAGES - 1 other streams before it, with the tokens that they have in common with it."""
    out: list[list] = []
    near: list[list] = []  # nearest first, one entry a stream; tokens in common with the row before
    last = None
    for row in rows:
        step = common_prefix(last[1], row[1]) if last is not None and last[0] == row[0] else 0
        if last is not None:
            near = [[last[2], step]] + [[s, min(n, step)] for s, n in near if s != last[2]]
            near = [x for x in near if x[1] >= RUN][:PAGES]
        out.append([x for x in near if x[0] != row[2]][: PAGES - 1])
        last = row
    return out


def _may_repeat(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Sorted suffixes without those that no undecided one has as a neighbour with RUN tokens in common.

    What the batches before and after may need stays: the first and last suffixes, up to PAGES pages.
    """
    n, at = batch.num_rows, batch.column(3).to_numpy()
    if n < PAGES:
        return batch
    if at.max() < 0:
        own = batch.column(2).to_pylist()
        ends = []
        for some in (own, own[::-1]):
            pages: set[int] = set()
            ends.append(next((k for k, page in enumerate(some) if not pages.add(page) and len(pages) == PAGES), n - 1) + 1)
        return batch if sum(ends) >= n else batch.filter(pa.array((np.arange(n) < ends[0]) | (np.arange(n) >= n - ends[1])))
    heads = batch.column(1)
    _, offsets, data = heads.buffers()
    starts = np.frombuffer(offsets, dtype=np.int32)[heads.offset : heads.offset + n].astype(np.int64)
    first = np.frombuffer(data, dtype=np.uint8)[starts[:, None] + np.arange(4 * RUN)]
    edges = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]).any(axis=1)])
    streams = batch.column(2).to_numpy()
    stay = (np.diff(np.r_[edges, n]) >= PAGES) & (np.minimum.reduceat(streams, edges) != np.maximum.reduceat(streams, edges)) & (np.maximum.reduceat(at, edges) >= 0)
    stay[[0, -1]] = True
    return batch.filter(pa.array(np.repeat(stay, np.diff(np.r_[edges, n]))))


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes, the runs that are boilerplate: host, stream, start and tokens.

    Rows with RUN tokens in common are worked on together, in pieces: of a longer run only the rows at
    the ends of a piece are kept for the next, as neighbours are what counts.
    """
    held: list[tuple] = []  # rows not reported yet, after ``known`` rows that are there as neighbours only
    known = 0

    def report(rows: list[tuple], first: int, until: int) -> pa.RecordBatch:
        before, after = _neighbours(rows), _neighbours(rows[::-1])[::-1]
        hits = [(r[0], r[2], r[3], n) for r, n in zip(rows[first:until], shared_lengths(rows, before, after)[first:until], strict=True) if n >= RUN and r[3] >= 0]
        return pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int32()))], ["host", "stream", "at", "n"])

    last = None
    for batch in map(_may_repeat, batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row != last:  # copies of a page, and a page's witnesses, have equal rows
                held.append(row)
            last = row
        # rows up to the last one that has PAGES - 1 other streams, or another prefix, after it are ready
        ready = len(held)
        streams: set = set()
        while ready > known and len(streams) < PAGES:
            ready -= 1
            streams.add(held[ready][2])
            if ready and (held[ready][0] != held[ready - 1][0] or common_prefix(held[ready][1], held[ready - 1][1]) < RUN):
                break
        if ready > known:
            yield report(held, known, ready)
            # keep as neighbours the rows back to PAGES - 1 other streams
            first, streams = ready, set()
            while first > 0 and len(streams) < PAGES and held[first - 1][0] == held[ready][0] and common_prefix(held[first - 1][1], held[first][1]) >= RUN:
                first -= 1
                streams.add(held[first][2])
            held, known = held[first:], ready - first
    if len(held) > known:
        yield report(held, known, len(held))


def uncovered(parts: list[str], runs: list[tuple[int, int]]) -> list[str]:
    """The blocks without the tokens of the runs (start, tokens); a block that is covered is empty."""
    own = _stream(parts)
    gone = [False] * len(own)
    for s, n in runs:
        gone[s : s + n] = [True] * n
    out, at = [], 0
    for p in parts:
        n = len(p.encode("utf-8", "replace").split())
        whole = not any(gone[at : at + n])
        out.append(p if whole else b" ".join(t for t, g in zip(own[at : at + n], gone[at : at + n], strict=True) if not g).decode())
        at += n
    return out


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for own, kinds, runs in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            undecided = uncovered([t for t, k in zip(own, kinds, strict=True) if k == UNDECIDED], [(x["at"], x["n"]) for x in runs or ()])
            left = iter(undecided)
            texts.append("\n\n".join(t for t in (next(left) if k == UNDECIDED else t for t, k in zip(own, kinds, strict=True)) if t))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Pages are read twice, as anchors in a shuffle and parsed pages in a table would need the disk at once.
    """
    small_batches(pages.sparkSession)
    parts = partitions_for(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    anchors = rows.select("url", "html").mapInArrow(_anchors, "anchor long")
    shared = written(anchors.repartition(parts, F.shiftright("anchor", TAG_BITS)).sortWithinPartitions("anchor").mapInArrow(_shared_hashes, "hash long"), "page-hashes")
    slices = pages.sparkSession.sparkContext.broadcast(_filter(shared))
    discard(shared)
    parsed = written(rows.mapInArrow(_parse, "page_id long, url string, host string, blocks array<string>, kinds array<tinyint>, rest string, stream long"), "page-blocks")
    suffixes = parsed.select("host", "blocks", "kinds", "rest", "stream").mapInArrow(_suffixes(slices), "host string, head binary, stream long, at int")
    array = suffixes.repartition(parts, "host", F.substring("head", 1, 4 * RUN)).sortWithinPartitions("host", "head", "stream", "at")
    runs = array.select("host", "head", "stream", "at").mapInArrow(_repeats, "host string, stream long, at int, n int")
    by_stream = written(runs.groupBy("host", "stream").agg(F.collect_set(F.struct("at", "n")).alias("runs")), "page-repeats")
    some = F.array_contains("kinds", F.lit(UNDECIDED).cast("tinyint"))
    cleaned = parsed.where(some).join(by_stream, ["host", "stream"], "left").select("page_id", "url", "blocks", "kinds", "runs").mapInArrow(_clean, "page_id long, url string, text string")
    text = parsed.where(~some).select("page_id", "url", F.array_join("blocks", "\n\n").alias("text")).unionByName(cleaned)
    return text.withColumn("n_chars", F.length("text").cast("long"))
