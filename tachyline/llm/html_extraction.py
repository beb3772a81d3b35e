"""Main text of pages, by deducing each host's template from equivalence classes of tokens.

A page is a sequence of tokens, each with its role: the path of open containers (class and id
included) and what stands there, a tag or a whole run of text. The occurrence vector of a role
is how often it occurs on each page of the host. It isn't collected: its number of pages and two sums of
count times a hash of the page stand for it, which add up in any order. A role is known by a 64-bit hash there;
every task hands on all it has seen. Roles of a host with equal
vectors form an equivalence class. A class is valid if it covers SUPPORT of the host's pages and
has a container in it; classes nest by their containers' paths, and the nested valid classes are the
host's template. Its containers delimit the slots. The main slot is the article (``article``,
``main`` or ``role=main``) if the template has one, and else the deepest container that holds
MAIN_SHARE of the host's text outside links and excluded parts. What is extracted is
the slot's text, without nested slots of menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments; where the slot isn't an article, the template's own
text runs are left out too. A page without its host's main slot is read by its own article,
or as a whole, with the same exclusions.

Null html is an empty page; a null url belongs to the empty host. Rows that share a page_id are
extracted one by one. Broken markup is taken as it comes: unclosed tags end with their container. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_entities
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tachyline.llm.common import ROWS_AT_ONCE, in_arrow, stored

SUPPORT = 0.8
MAIN_SHARE = 0.6
LEAST_PAGES = 8
PAGES_A_SALT = 1000
#: Roles that a task adds up before it hands them on.
MOST_ROLES = 100_000
ROLES_AT_ONCE = 10_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|svg|iframe|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_SPACE = re.compile(r"\s+")

CONTAINERS = frozenset(
    "html body div section article main nav header footer aside form table tbody thead tr td th ul ol dl menu "
    "dialog fieldset details figure center head".split()
)
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre hr address figcaption caption summary legend option".split()
)
EXCLUDED = frozenset("head nav header footer aside form menu dialog button".split())
_EXCLUDED_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner\w*|cookie\w*|consent|notice\w*|alert|sidebar\w*|menu\w*|nav\w*|footer\w*|"
    r"header\w*|comment\w*|replies|disqus\w*|share\w*|social\w*|promo\w*|related|newsletter\w*|subscribe\w*|popup|modal|"
    r"sponsor\w*|breadcrumb\w*|login|form|widget\w*)(?:$|[\s_-])",
    re.IGNORECASE,
)


class Container:
    __slots__ = ("tag", "path", "excluded", "article")

    def __init__(self, tag: str, path: str, excluded: bool, article: bool):
        self.tag, self.path, self.excluded, self.article = tag, path, excluded, article


ROOT = Container("", "", False, False)


def opened(tag: str, attributes: str, parent: Container) -> Container:
    names = role = ""
    if attributes and "=" in attributes:
        found = {name.lower(): a or b or c for name, a, b, c in _ATTRIBUTE.findall(attributes)}
        role = found.pop("role", "").lower()
        names = " ".join(found[name] for name in sorted(found))
    out = tag in EXCLUDED or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog")
    out = out or (bool(names) and bool(_EXCLUDED_NAME.search(names)) and tag not in ("html", "body", "article", "main"))
    article = tag in ("article", "main") or role == "main"
    return Container(tag, f"{parent.path}/{tag}" + (f"[{names}]" if names else ""), parent.excluded or out, article)


def events(html: str) -> Iterator[tuple[str, str, Container, bool]]:
    """(kind, value, container, in a link): "open", "break" and "text", in the order of the page."""
    stack, place, in_link = [ROOT], 0, False
    for match in _TOKEN.finditer(html):
        if match.start() > place:
            yield "text", html[place : match.start()], stack[-1], in_link
        place = match.end()
        tag = match.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            yield "text", " ", stack[-1], in_link
        if tag not in BLOCKS:
            if tag == "a":
                in_link = not match.group(2)
            continue
        in_link = False
        if tag in CONTAINERS:
            if match.group(2):
                at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
                if at:
                    yield "break", "", stack[-1], False
                    del stack[at:]
            else:
                stack.append(opened(tag, match.group(4), stack[-1]))
                yield "open", "", stack[-1], False
        yield "break", "", stack[-1], False
    if place < len(html):
        yield "text", html[place:], stack[-1], in_link


def trimmed(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def clean(text: str) -> str:
    return trimmed(html_entities.unescape(text))


def text_role(path: str, text: str) -> str:
    return f"{path}#{text}"


def roles(html: str) -> tuple[dict[str, int], dict[str, int]]:
    """How often each role occurs, and the characters of free text within each container."""
    counts: dict[str, int] = defaultdict(int)
    chars: dict[str, int] = defaultdict(int)
    for kind, value, container, in_link in events(html):
        if kind == "open":
            counts[container.path] += 1
        elif kind == "text" and not container.excluded:
            text = clean(value)
            if text:
                counts[text_role(container.path, text)] += 1
                if not in_link:
                    path = container.path
                    while path:
                        chars[path] += len(text)
                        path = path[: path.rfind("/")]
    return counts, chars


def role_hash(role: str) -> int:
    return int.from_bytes(hashlib.blake2b(role.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#:@]*)", 1), F.lit("")))


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """(host, role_hash, role, container, pages, low, high, chars): each task's share of the vectors.

    Of a window of one host's pages, a task names the roles that are on half of them or more; of the others it
    hands on the numbers alone. A role on SUPPORT of all pages is on as many of some window's, and so is named there.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, list]] = {}
        seen: dict[str, int] = defaultdict(int)
        size = 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            rows = [
                (host, role_hash(role), role if 2 * values[1] >= seen[host] else None, *values)
                for host, found in held.items()
                for role, values in found.items()
            ]
            rows += [(host, role_hash(""), "", True, count, 0, 0, 0) for host, count in seen.items()]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), *[pa.int64()] * 4)
            names = ("host", "role_hash", "role", "container", "pages", "low", "high", "chars")
            for at in range(0, len(rows), ROLES_AT_ONCE):
                some = zip(*rows[at : at + ROLES_AT_ONCE])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(some, kinds)], names=names)

        for batch in batches:
            for host, page, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts, chars = roles(html or "")
                if not counts:
                    continue
                seen[host] += 1
                found = held.setdefault(host, {})
                for role, count in counts.items():
                    values = found.get(role)
                    if values is None:
                        values = found[role] = ["#" not in role, 0, 0, 0, 0]
                        size += 1
                    values[1] += 1
                    values[2] += count * (page & 0x7FFFFFFF)
                    values[3] += count * (page >> 32 & 0x7FFFFFFF)
                    values[4] += chars.get(role, 0)
                if size > MOST_ROLES:
                    yield from handed_on()
                    held, size = {}, 0
                    seen.clear()
        if seen:
            yield from handed_on()

    keyed = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "html").alias("page"), "html")
    return keyed.transform(
        in_arrow, work,
        "host string, role_hash long, role string, container boolean, pages long, low long, high long, chars long",
    )


def templates(pages: DataFrame) -> DataFrame:
    """(host, n_pages, main, own_text): the main slot's path and the template's text runs."""
    sums = [F.sum(name).alias(name) for name in ("pages", "low", "high", "chars")]
    parts = stored(occurrence_vectors(pages), "occurrence-vectors")
    hosts = parts.filter(F.col("role") == "").groupBy("host").agg(F.sum("pages").alias("n_pages"))
    vectors = parts.filter(F.coalesce(F.col("role") != "", F.lit(True))).groupBy("host", "role_hash", "container").agg(*sums)
    covered = stored(vectors.join(hosts, "host").filter(F.col("pages") >= SUPPORT * F.col("n_pages")), "covered")
    names = parts.filter(F.col("role") != "").select("host", "role_hash", "role").distinct()
    covered = covered.join(names, ["host", "role_hash"])
    role = F.struct("role", "container", "chars")
    classes = covered.groupBy("host", "n_pages", "pages", "low", "high").agg(
        F.collect_list(role).alias("roles"), F.max("container").alias("valid")
    )
    nested = classes.filter("valid").groupBy("host", "n_pages").agg(F.flatten(F.collect_list("roles")).alias("roles"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row["host"], row["n_pages"], *slots(row["roles"], row["n_pages"])) for row in batch.to_pylist()]
            hosts, counts, main, own = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(counts, pa.int64()), pa.array(main, pa.string()), pa.array(own, pa.list_(pa.int64()))],
                names=["host", "n_pages", "main", "own_text"],
            )

    return nested.transform(in_arrow, pick, "host string, n_pages long, main string, own_text array<long>")


def slots(found: list[dict], n_pages: int) -> tuple[str | None, list[int]]:
    """The path of the template's main slot, and checks of its own text runs."""
    containers = sorted((row["role"], row["chars"]) for row in found if row["container"])
    named = [path for path, _ in containers if is_article(path)]
    if named:
        return min(named, key=lambda path: (path.count("/"), path)), []
    whole = max((chars for _, chars in containers), default=0)
    deep = [path for path, chars in containers if chars and chars >= MAIN_SHARE * whole]
    main = max(deep, key=lambda path: (path.count("/"), path), default=None)
    if n_pages < LEAST_PAGES:
        return main, []
    return main, sorted(zlib.crc32(row["role"].encode()) for row in found if not row["container"])


def is_article(path: str) -> bool:
    return path.rpartition("/")[2].partition("[")[0] in ("article", "main")


def extracted(html: str, main: str | None, own_text: frozenset[int]) -> str:
    """The page's main text: its blocks, with an empty line between."""
    seen = list(events(html))
    if main is None or not any(kind == "open" and c.path == main for kind, _, c, _ in seen):
        main = next((c.path for kind, _, c, _ in seen if kind == "open" and c.article and not c.excluded), "")
    blocks, now = [], []
    for kind, value, container, _ in seen:
        if kind == "text":
            path = container.path
            if not container.excluded and (not main or path == main or path.startswith((main + "/", main + "["))):
                if not own_text or zlib.crc32(text_role(path, clean(value)).encode()) not in own_text:
                    now.append(html_entities.unescape(value))  # a reference doesn't go on behind a tag
        elif now:
            blocks.append(trimmed("".join(now)))
            now = []
    if now:
        blocks.append(trimmed("".join(now)))
    return "\n\n".join(block for block in blocks if block)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    known = stored(templates(pages), "templates")
    # A host of many pages is dealt to several tasks, each with the host's template.
    salts = (F.col("n_pages") / PAGES_A_SALT).cast("int") + 1
    salted = known.withColumn("salts", salts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    sizes = known.select("host", salts.alias("salts"))
    many = sizes.filter(F.col("salts") > 1)
    rows = pages.select(host_of(F.col("url")).alias("host"), "page_id", "url", "html")
    return _extract(rows, salted, many)


def _extract(rows: DataFrame, salted: DataFrame, many: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                html, main, own = (some.column(i).to_pylist() for i in (2, 3, 4))
                texts = [extracted(h or "", m, frozenset(o or ())) for h, m, o in zip(html, main, own)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    salt = F.pmod(F.xxhash64("page_id", "url"), F.coalesce(F.col("salts"), F.lit(1))).cast("int")
    placed = rows.join(many, "host", "left").withColumn("salt", salt).drop("salts")
    joined = placed.join(salted.select("host", "salt", "main", "own_text"), ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "main", "own_text").transform(
        in_arrow, work, rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    )
