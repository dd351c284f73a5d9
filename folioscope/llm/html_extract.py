"""Main text of web pages.

A page is read as blocks of text. What lies in menus, headers, footers, asides,
forms, scripts and the like, by element or by the words of its class, id or
role, is never main text. If the page marks its content (``article``, or
``main`` where articles are only parts of it), the blocks in there are
candidates, otherwise all others are.

The suffix array of the page's host decides about every candidate. The token
streams of a host's pages, with a token between blocks, are concatenated;
suffixes are dealt to buckets by their first ``RUN`` tokens, so that a host of
any size spreads over tasks. A bucket sorts its suffixes, takes the longest
common prefixes of neighbours, and finds for each suffix the longest string of
``RUN`` to ``DEPTH`` tokens that enough distinct pages of the host share.
Covered runs of a page that marks nothing are removed and the unique runs kept;
``SHARE`` of the host's pages, and two at least, make a repeat. Of marked
content, whole blocks of up to ``LONGEST`` tokens are removed if ``MARKED`` of
the host's pages, and ``MARKED_LEAST`` at least, repeat them: lines like
"subscribe to our letter" within articles. There the array takes the suffix at
the beginning of each block, its tail told by a fingerprint; elsewhere all.

Pages of a host with equal content are one page in this, so a text that is
published again under another address is not held against itself.

Cases: a null or empty page, or one without text, gives an empty string; a page
cut off within an element ends there; repeated rows of an id are pages each; a
null url is a host of its own; an empty table gives an empty result; other
columns are not read; nothing is capped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import discard, salted, salted_table, spread_join, written
from folioscope.llm.suffix_dedup import squeeze, unsqueeze

#: Tokens that a repeat has at least, and up to which suffixes are compared.
RUN, DEPTH = 6, 16
#: Share of a host's distinct pages that repeat what is boilerplate.
SHARE = 0.1
#: The same for blocks of marked content, pages at least, and tokens at most.
MARKED, MARKED_LEAST, LONGEST = 0.5, 8, 48
#: Suffixes that a bucket of the array holds, about.
BUCKET = 1 << 21
#: Suffixes that a task holds before it sends them.
HELD = 1 << 18
#: Elements whose content is never main text.
OUT = frozenset("nav header footer aside form button select textarea label option menu dialog noscript template svg canvas iframe object audio video map head".split())
RAW = ("script", "style", "title", "noscript", "iframe", "textarea", "template", "svg")
#: Words of class, id or role that name what is not main text.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer footnav masthead topbar "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond reply replies disqus related recommended share sharing social "
    "pagination pager widget toolbar contentinfo complementary search skip".split()
)
BLOCK = frozenset(
    "p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hr address details summary fieldset legend center body html hgroup".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
KEPT = frozenset("article main body html".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
#: Words that make a name say what an element has or lacks, not what it is.
ABOUT = frozenset("has no not with without show hide is post page single type format category tag hentry entry".split())
#: Names of an element that holds the content, whatever else it is named.
CONTENT = frozenset("content article story article-body article-content entry-content post-body post-content story-body main-content".split())
NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
END_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in RAW}


def _named_out(attributes: str) -> bool:
    if "=" not in attributes:
        return False
    for m in NAME.finditer(attributes):
        names = (m[1] or m[2] or m[3] or "").lower().split()
        if CONTENT.intersection(names):
            return False
        for name in names:
            words = WORD.findall(name)
            if words and words[0] not in ABOUT and any(w in NAMED for w in words):
                return True
    return False


def blocks(page: str | None) -> list[tuple[str, str | None]]:
    """(text, place) of the blocks of a page; place: article, inner (an article
    in main), main, body, or None for what is left out. Titles, scripts and
    styles have no block."""
    if not page:
        return []
    out: list[tuple[str, str | None]] = []
    text: list[str] = []
    inside = {"article": 0, "main": 0}
    skip, depth, at, n = "", 0, 0, len(page)

    def close() -> None:
        if text:
            # references are decoded in the whole block: a tag cannot split one
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((joined, None if skip else PLACES[inside["article"] > 0, inside["main"] > 0]))
            text.clear()

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name, closing = name.lower(), bool(m[1])
        if not closing and name in END_RAW:
            end = END_RAW[name].search(page, at)
            at = end.end() if end else n
            if name in BLOCK or name == "title":
                close()
            continue
        if skip:
            # marked content ends what was left open before it
            if not closing and name in ("article", "main") and name != skip and not _named_out(m[3]):
                close()
                skip, depth = "", 0
            elif name == skip:
                close()
                depth += -1 if closing else 1
                if not depth:
                    skip = ""
                continue
            else:
                if name in BLOCK:
                    close()
                continue
        elif not closing and name not in KEPT - {"article"} and name not in VOID and (name in OUT or _named_out(m[3])):
            close()
            skip, depth = name, 1
            continue
        if name in BLOCK or name in OUT:
            close()
        elif name == "br":
            text.append(" ")
        if name in inside:
            inside[name] = max(0, inside[name] + (-1 if closing else 1))
    close()
    return out


PLACES = {(True, True): "inner", (True, False): "article", (False, True): "main", (False, False): "body"}


def marked(found: list[tuple[str, str | None]]) -> set[str]:
    """The places that hold the marked content; none if the page marks none.

    Articles, but all of ``main`` where they are less than half of it.
    """
    size = {p: sum(len(t) for t, q in found if q == p) for p in PLACES.values()}
    if size["article"] or size["inner"] and size["inner"] >= size["main"]:
        return {"article", "inner"}
    return {"inner", "main"} if size["inner"] or size["main"] else set()


#: What a block is to the array: evidence alone, a candidate, or marked content.
LEFT_OUT, BODY, IN_CONTENT = 0, 1, 2


def kinds(found: list[tuple[str, str | None]]) -> list[int | None]:
    """The kind of each block; None for what is outside of marked content but not left out."""
    places = marked(found)
    return [LEFT_OUT if p is None else IN_CONTENT if p in places else None if places else BODY for _, p in found]


def _stream(found: list[tuple[str, str | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The page's tokens as hashes, 0 before each block and at the end, and the
    place and kind of each suffix of it that the array holds.

    Of marked content only blocks of ``RUN`` to ``LONGEST`` tokens can repeat;
    others stand for one token.
    """
    tokens, places, kind_of = [0], [], []
    for (t, _), kind in zip(found, kinds(found), strict=True):
        if kind is None:
            continue
        words = t.split()
        at, n = len(tokens), len(words)
        if kind == IN_CONTENT and not RUN <= n <= LONGEST:
            tokens += [_token(t), 0]
            continue
        tokens += map(_token, words)
        tokens.append(0)
        # a run may begin with the mark before the block
        first = [at] if kind == IN_CONTENT else range(at - 1, at + n)
        places += first
        kind_of += [kind] * len(first)
    return np.array(tokens, "<u4"), np.array(places, "<u4"), np.array(kind_of, np.uint8)


def _token(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 32 | 1


def _contexts(tokens: np.ndarray, places: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The first ``DEPTH`` tokens of suffixes; after the page's end comes what no
    token is. Of ``whole`` blocks, two hashes of the block follow ``RUN`` tokens."""
    end = np.arange(1, DEPTH + 1, dtype="<u4") * np.uint32(2)
    out = np.lib.stride_tricks.sliding_window_view(np.concatenate([tokens, end]), DEPTH)[places].copy()
    for k in np.flatnonzero(whole):
        at = int(places[k])
        block = tokens[at : at + int(np.argmax(tokens[at:] == 0))]
        h = xxhash.xxh3_64_intdigest(block.tobytes())
        out[k, RUN:] = end[-1]
        out[k, RUN : RUN + 2] = h & 0xFFFFFFFF, h >> 32
    return out


def _host(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").lower()).split("/")[0]


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page its host, a hash of its content, its stream and the number of its suffixes."""
    for b in batches:
        hosts, contents, numbers, streams = [], [], [], []
        for url, page in zip(b.column("url").to_pylist(), b.column("html"), strict=True):
            found = blocks(page.as_py())
            host = xxhash.xxh3_64_intdigest(_host(url))
            hosts.append(host)
            contents.append(xxhash.xxh3_64_intdigest("\n".join([t for (t, _), k in zip(found, kinds(found), strict=True) if k]), seed=host))
            stream = _stream(found)
            numbers.append(len(stream[1]))
            streams.append(squeeze(*stream))
        as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("_owner"), as_long(hosts), as_long(contents), pa.array(numbers, pa.int64()), pa.array(streams, pa.binary())], ["_owner", "_host", "_content", "suffixes", "stream"])


#: pages: how many have the suffix; own: tokens that it shares with another suffix
#: of the same page, so the page counts among those that share more.
SUFFIX = np.dtype([("host", "<u8"), ("context", "<u4", (DEPTH,)), ("pages", "<u4"), ("own", "u1"), ("owner", "<i8"), ("place", "<u4"), ("need", "<u4")])


def _suffixes(b: pa.RecordBatch, k: int) -> np.ndarray:
    """The suffixes of a page that may begin a repeat: as evidence, if the page
    stands for its content, and as questions."""
    tokens, places, kind = unsqueeze(b.column("stream")[k].as_py(), "<u4", "<u4", np.uint8)
    # a repeat does not begin within RUN tokens of the page's end
    some = (places + RUN <= len(tokens)) | (kind == IN_CONTENT)
    places, kind = places[some], kind[some]
    x = np.zeros(len(places), SUFFIX)
    x["host"] = b.column("_host")[k].as_py() & 0xFFFFFFFFFFFFFFFF
    x["context"], x["place"] = _contexts(tokens, places, kind == IN_CONTENT), places
    x["owner"], x["pages"] = b.column("_owner")[k].as_py(), b.column("first")[k].as_py()
    x["need"] = np.array([0, b.column("need_body")[k].as_py(), b.column("need_content")[k].as_py()])[kind]
    return x


def _key(x: np.ndarray) -> np.ndarray:
    """Host and context as bytes that sort like them."""
    raw = np.concatenate([x["host"].astype(">u8")[:, None].view(np.uint8), np.ascontiguousarray(x["context"].astype(">u4")).view(np.uint8)], axis=1)
    return np.ascontiguousarray(raw).view(f"V{raw.shape[1]}").reshape(-1)


def _dealt(buckets: int, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Suffixes packed by bucket, which their host and first tokens choose."""
    if not len(x):
        return
    h = x["host"].copy()
    for k in range(RUN):
        h = (h ^ x["context"][:, k]) * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((x["place"], x["owner"], h, bucket))
    x, bucket = x[order], bucket[order]
    at = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0]))
    sent = [squeeze(y["host"].copy(), np.ascontiguousarray(y["context"]).reshape(-1), *(y[c].copy() for c in SUFFIX.names[2:])) for y in np.split(x, at[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(sent, pa.binary())], ["bucket", "sent"])


def _common_prefix(x: np.ndarray) -> np.ndarray:
    """The tokens that each suffix shares with the one before it."""
    same = (x["context"][1:] == x["context"][:-1]) & (x["host"][1:] == x["host"][:-1])[:, None]
    return np.concatenate([[0], np.logical_and.accumulate(same, axis=1).sum(1)])[: len(x)]


def _common_prefix(x: np.ndarray) -> np.ndarray:
    """The tokens that each suffix shares with the one before it."""
    same = (x["context"][1:] == x["context"][:-1]) & (x["host"][1:] == x["host"][:-1])[:, None]
    return np.concatenate([[0], np.logical_and.accumulate(same, axis=1).sum(1)])[: len(x)]


def _merged(held: list[np.ndarray]) -> np.ndarray:
    """Suffixes of pages, with what each shares with others of its page; of those
    that ask nothing the distinct ones with the number of pages that have them."""
    x = np.concatenate(held)
    page = np.repeat(np.arange(len(held)), [len(y) for y in held])
    rank = np.unique(_key(x), return_inverse=True)[1]
    order = np.lexsort((rank, page))
    x, page, rank = x[order], page[order], rank[order]
    x["own"] = np.where(np.diff(page, prepend=-1) != 0, 0, _common_prefix(x))
    ask = x["need"] > 0
    some = ~ask & (x["own"] < DEPTH) & (x["pages"] > 0)
    _, at, n = np.unique(rank[some] * (DEPTH + 1) + x["own"][some], return_index=True, return_counts=True)
    evidence = x[some][at]
    evidence["pages"], evidence["place"], evidence["owner"] = n, 0, 0
    return np.concatenate([evidence, x[ask]])


def _sent(buckets: int):
    """Suffixes of pages, held until there are ``HELD``, merged, and dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for k in range(b.num_rows):
                x = _suffixes(b, k)
                held.append(x)
                n += len(x)
                if n >= HELD:
                    yield from _dealt(buckets, _merged(held))
                    held, n = [], 0
        if n:
            yield from _dealt(buckets, _merged(held))

    return run


def repeats(x: np.ndarray) -> np.ndarray:
    """The part of the suffix array that a bucket holds: for each suffix the
    length of its longest prefix of ``RUN`` tokens or more that ``need`` pages
    share (0: none, or the suffix asks nothing)."""
    order = np.argsort(_key(x), kind="stable")
    y = x[order]
    lcp = _common_prefix(y)
    length = np.zeros(len(x), np.int64)
    for n in range(RUN, DEPTH + 1):
        at = np.flatnonzero(lcp < n)
        pages = np.where(y["own"] < n, y["pages"], 0).astype(np.int64)
        pages = np.repeat(np.add.reduceat(pages, at), np.diff(np.append(at, len(y))))
        length[order[(y["need"] > 0) & (pages >= y["need"])]] = n
    return length


def _sorted_part(table):
    """One bucket of the array: places of candidates that enough pages have."""
    columns = [unsqueeze(x, "<u8", "<u4", "<u4", "u1", "<i8", "<u4", "<u4") for x in table["sent"].to_pylist()]
    x = np.zeros(sum(len(c[0]) for c in columns), SUFFIX)
    for k, name in enumerate(SUFFIX.names):
        x[name] = np.concatenate([c[k] for c in columns]).reshape(x[name].shape)
    length = repeats(x)
    x, length = x[length > 0], length[length > 0]
    return pa.table({"_owner": pa.array(x["owner"], pa.int64()), "place": pa.array(x["place"].astype(np.int64)), "length": pa.array(length, pa.int64())})


def _packed(found: list[tuple[str, str | None]]) -> bytes:
    """The candidates, and of what is left out the number of tokens, compressed."""
    lines = [f"{kind}{t if kind else len(t.split())}" for (t, _), kind in zip(found, kinds(found), strict=True) if kind is not None]
    return zstandard.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 3)


def decided(lines: list[tuple[int, str]], places: np.ndarray, lengths: np.ndarray) -> list[str]:
    """The candidates, without what the array covers.

    Of a block of a page that marks nothing, covered stretches of ``RUN`` tokens
    or more go, or all of it; a few covered tokens only continue what its
    neighbours repeat. A block of marked content goes only as a whole.
    """
    width = [int(t) if kind == LEFT_OUT else 1 if kind == IN_CONTENT and not RUN <= len(t.split()) <= LONGEST else len(t.split()) for kind, t in lines]
    edge = np.zeros(2 + sum(width) + len(width) + DEPTH, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + lengths, -1)
    cover = np.cumsum(edge) > 0
    whole = set(places[lengths == DEPTH].tolist())
    out, at = [], 1
    for (kind, t), n in zip(lines, width, strict=True):
        own, begin = cover[at : at + n].copy(), at
        at += n + 1
        if kind == IN_CONTENT:
            if begin not in whole:
                out.append(t)
        elif kind == BODY:
            edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                if b - a < min(RUN, n):
                    own[a:b] = False
            rest = " ".join(w for w, c in zip(t.split(), own, strict=True) if not c)
            if rest:
                out.append(rest)
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = pa.array([_packed(blocks(x.as_py())) for x in b.column("html")], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("_owner"), packed, b.column("_salt")], ["page_id", "url", "_owner", "packed", "_salt"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for packed, places, lengths in zip(b.column("packed").to_pylist(), b.column("places").to_pylist(), b.column("lengths").to_pylist(), strict=True):
            text = zstandard.decompress(packed).decode("utf-8", "surrogatepass")
            lines = [(int(x[0]), x[1:]) for x in text.split("\n")] if text else []
            texts.append("\n".join(decided(lines, np.array(places or [], np.int64), np.array(lengths or [], np.int64))))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def covered(pages: DataFrame) -> DataFrame:
    """(_owner, places, lengths) of the pages (_owner, url, html) that have
    candidates which their host repeats."""
    streams = pages.mapInArrow(_streams, "_owner long, _host long, _content long, suffixes long, stream binary")
    # numbered as they are written
    streams = written(streams.withColumn("_row", F.monotonically_increasing_id()))
    buckets = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * (streams.agg(F.sum("suffixes")).first()[0] or 0) // BUCKET)
    # one row a page asks, and one row a content of a host counts
    owners = written(streams.groupBy("_owner", "_host", "_content").agg(F.min("_row").alias("_row")))
    contents = written(owners.groupBy("_host", "_content").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")))
    # written so that the planner sees its size
    hosts = written(contents.groupBy("_host").agg(F.count(F.lit(1)).alias("_n")))
    asking = spread_join(owners, contents.drop("_n"), ["_host", "_content"], F.col("_row"), contents)
    asking = spread_join(asking, hosts, ["_host"], F.col("_row")).where("_n > 1")
    need = lambda share, least: F.greatest(F.lit(least), F.ceil(F.col("_n") * share)).cast("long")
    asking = asking.select("_row", (F.col("_row") == F.col("_first")).cast("int").alias("first"), need(SHARE, 2).alias("need_body"), need(MARKED, MARKED_LEAST).alias("need_content"))
    sent = streams.join(asking, "_row").select("_owner", "_host", "stream", "first", "need_body", "need_content").mapInArrow(_sent(buckets), "bucket int, sent binary")
    found = sent.groupBy("bucket").applyInArrow(_sorted_part, "_owner long, place long, length long")
    out = written(found.groupBy("_owner").agg(F.collect_list(F.struct("place", "length")).alias("p")).select("_owner", F.col("p.place").alias("places"), F.col("p.length").alias("lengths")))
    for t in (streams, owners, contents, hosts):
        discard(t)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_owner", F.xxhash64("url", "html"))
    places = covered(rows.select("_owner", "url", "html"))
    # what is exchanged are the candidates, compressed; copies of a page are dealt apart
    packed, hot = salted(rows, ["_owner"], F.xxhash64("page_id"))
    packed = packed.mapInArrow(_read, "page_id long, url string, _owner long, packed binary, _salt int")
    joined = packed.join(salted_table(places, ["_owner"], hot), ["_owner", "_salt"], "left")
    return joined.select("page_id", "url", "packed", "places", "lengths").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
