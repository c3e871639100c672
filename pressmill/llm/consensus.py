"""Operator 10: main text of pages, by consensus paths of their hosts.

1. Every page is parsed and its containers are scored: characters of running text, less
   those in links, credited to the container around each block and by half to the one above.  The page votes for
   the generalised path of its best container: tags with their classes, digits made alike.
2. Votes are summed inside tasks, then by host and path.  A path that has at least
   ``SHARE`` of the votes of its host wins; a host has at most 1 / SHARE winners.
3. Every page is parsed again and the containers at the winning path are extracted: the
   winning path that is best on the page, or scores most there, or else the page's own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles
are left out, by tag or by the words of class and id; forms and such words don't leave out what holds most of a page.  Character references are decoded,
white space inside a block becomes one space, blocks are joined by a blank line.  Time and memory grow with the length
of a page, however deep its elements are nested and whatever quotes it leaves open.  Null or empty html
gives the empty text.  Pages without url, or with a url without host, share the empty host.  Repeated rows
give repeated results.  An empty input gives no rows; extra columns are not read.
"""

import html as _html
import itertools
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from pressmill.llm.common import stored, with_package

SHARE = 0.1
HELD_VOTES = 20_000
UNWANTED_TRUST = 0.5

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre "
                   "section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div td body center blockquote dd fieldset".split())
DROPPED = frozenset("aside button canvas datalist dialog footer form head iframe input label menu nav noframes "
                    "noscript object optgroup option select svg template textarea video audio map".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Opening one of these ends an open one of the same group.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl td th body html article section div main".split())
UNWANTED = frozenset("ad ads adv advert advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment "
                     "comments commentlist consent cookie cookies disclaimer discussion discussions disqus feedback footer gdpr header login "
                     "masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination "
                     "popup promo promoted promotion promotions recommended related replies reply respond share sharing "
                     "sidebar signup skip social sponsor sponsored sponsors subscribe toolbar topbar widget widgets".split())

_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"'=]|="[^"<>]*")*+)>""")    # most tags; it reads no further than the next "<"
_OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?/])")
_STOP = re.compile(r"""(>)|=\s*(["'])""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")


class _Tags:
    """Tags and comments of a page, each found in time that grows with its length.

    A quote opens a value only after an equals sign.  A tag whose quotes don't close ends at its first ">".
    """

    def __init__(self, page):
        self.page, self.next_stop, self.seen_from, self.comments = page, None, 0, True
        self.hopeless = set()    # stops from which no tag ends

    def _stop(self, at):
        found = self.next_stop
        if found is None or not self.seen_from <= at <= found.start():
            found = _STOP.search(self.page, at)
            if found is None:
                return None
            self.next_stop, self.seen_from = found, at
        return found

    def _end(self, start):
        at, passed = start, []
        while (stop := self._stop(at)) is not None and stop.start() not in self.hopeless:
            if stop[1]:
                return stop.end()
            passed.append(stop.start())
            at = self.page.find(stop[2], stop.end()) + 1
            if not at:
                break
        self.hopeless.update(passed)
        return self.page.find(">", start) + 1

    def after(self, at):
        """start, end, "/" or "", name and attributes of the next tag (no name: a comment); None if there is none.

        What looks like a tag that the page ends in goes to the end of the page.
        """
        page = self.page
        at = page.find("<", at)
        if at < 0:
            return None
        tag = _PLAIN.match(page, at)
        if tag:
            return at, tag.end(), tag[1], tag[2].lower(), tag[3]
        tag = _OPENING.search(page, at)
        if tag is None:
            return None
        start = tag.start()
        if not tag[2]:
            close = page.find("-->", start + 2) if self.comments and tag[0] == "<!--" else -1
            if close >= 0:
                return start, close + 3, "", "", ""
            self.comments = self.comments and tag[0] != "<!--"
            return start, page.find(">", tag.end()) + 1 or len(page), "", "", ""
        end = self._end(tag.end())
        if not end:
            return start, len(page), "", "", ""
        return start, end, tag[1], tag[2].lower(), page[tag.end():end - 1]


class _Paths:
    """Tag-class paths as a tree: a path is the number of its parent and one part, so deep pages stay small."""

    def __init__(self):
        self.number, self.parent, self.part, self.whole, self.depth = {}, [-1], [""], [-1], [0]

    def below(self, path, tag, classes):
        part = ".".join([tag, *classes])
        found = self.number.setdefault((path, part), len(self.parent))
        if found == len(self.parent):
            self.parent.append(path)
            self.part.append(part)
            # The nearest article or main, itself included.
            self.whole.append(found if tag in ("article", "main") else self.whole[path])
            self.depth.append(self.depth[path] + 1)
        return found

    def text(self, path):
        parts = []
        while path > 0:
            parts.append(self.part[path])
            path = self.parent[path]
        return "".join(f"/{p}" for p in reversed(parts))

    def find(self, texts):
        """Numbers of those of the paths given as texts that the page has: {number: text}."""
        found, reached = {}, {0: {t: 0 for t in texts}}
        for path in range(1, len(self.parent)):
            above = reached.get(self.parent[path])
            if above:
                part = f"/{self.part[path]}"
                here = {t: n + len(part) for t, n in above.items() if t.startswith(part, n)}
                if here:
                    reached[path] = here
                    found.update((path, t) for t, n in here.items() if n == len(t))
        return found


class _Element:
    __slots__ = ("tag", "path", "dropped", "score", "parent", "box", "first", "last", "suspect", "trust")

    def __init__(self, tag, path, dropped, parent, first, suspect=None, trust=1.0):
        self.tag, self.path, self.dropped, self.parent = tag, path, dropped, parent
        self.suspect, self.trust, self.score = suspect, trust, 0.0
        self.box = self if parent is None or tag in CONTAINERS else parent.box
        self.first, self.last = first, None     # its blocks


class _Suspect:
    """An element with unwanted words: its running text, and what is in it beside further such elements."""
    __slots__ = ("at", "parent", "text", "whole", "inside")

    def __init__(self, at, parent):
        self.at, self.parent, self.text, self.whole, self.inside = at, parent, 0, False, []


class Page:
    """Containers of a page in page order, its blocks, and sums of their running text."""

    def __init__(self, boxes, blocks, running, paths):
        self.boxes, self.blocks, self.paths = boxes, blocks, paths
        self.sums = [0.0, *itertools.accumulate(running)]

    def running(self, box):
        return self.sums[box.last] - self.sums[box.first]


def _named(attributes):
    found = {}
    if "=" in attributes or "hidden" in attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), a or b or c)
    return found


def _hidden(names):
    return "hidden" in names or names.get("aria-hidden", "").strip().lower() == "true" or bool(_UNSEEN.search(names.get("style", "")))


def _unwanted(names, in_article):
    words = set(w.lower() for w in _PARTS.findall(f"{names.get('class', '')} {names.get('id', '')} {names.get('role', '')}"))
    if in_article:
        words -= {"header"}
    return bool(words & UNWANTED)


def containers_of(page):
    """Containers of a page, with its blocks; a block belongs to all containers around it.

    Forms and elements with unwanted words are left out, but not those that hold most running text of a page
    without article or main elsewhere: these are read, at half their score.
    """
    read, suspects, running, whole = _read(page, frozenset())
    total = running
    for suspect in reversed(suspects):      # inner ones come later in the page
        if suspect.parent is None:
            total += suspect.text
        else:
            suspect.parent.text += suspect.text
            suspect.parent.inside.append(suspect)
    kept, level = [], [s for s in suspects if s.parent is None]
    while level and not whole:
        most = max(level, key=lambda s: s.text)
        if 2 * most.text <= total:
            break
        kept.append(most.at)
        whole, level = most.whole, most.inside
    return _read(page, frozenset(kept))[0] if kept else read


def _read(page, kept):
    """Page, its suspects in page order, length of running text that is read, whether article or main hold text."""
    suspects, running, whole = [], 0, False
    paths, tags = _Paths(), _Tags(page)
    root = _Element("", 0, False, None, 0)
    stack, found, piece, links, linked = [root], [], [], 0, 0
    blocks, block_running = [], []

    def end_block():
        nonlocal linked
        text = _SPACE.sub(" ", _html.unescape("".join(piece))).strip() if piece else ""
        piece.clear()
        if text:
            box = stack[-1].box
            free = max(len(text) - linked, 0) * (1.0 if len(text) >= 25 else 0.25) * box.trust
            box.score += free
            if box.parent is not None:
                box.parent.box.score += free / 2
            # Running text of more words than links.
            block_running.append(free if len(text) >= 25 and 2 * linked <= len(text) else 0.0)
            blocks.append(text)
        linked = 0

    def close(depth):
        nonlocal links
        for element in stack[depth:]:
            links -= element.tag == "a"
            open_tags[element.tag] -= 1
            element.last = len(blocks)
        del stack[depth:]

    at, end, open_tags = 0, len(page), Counter()
    while at < end:
        tag = tags.after(at)
        stop = end if tag is None else tag[0]
        top = stack[-1]
        if stop > at and not top.dropped:
            text = page[at:stop]
            piece.append(text)
            if links:
                linked += stop - at
            elif stop - at >= 25 and (length := len(text.strip())) >= 25:
                running += length
            if not whole and paths.whole[top.path] >= 0 and text.strip():
                whole = True
        elif stop > at and top.suspect is not None:
            length = len(page[at:stop].strip())
            if length >= 25 and not links:
                top.suspect.text += length
            if length and paths.whole[top.path] >= 0:
                top.suspect.whole = True
        if tag is None:
            break
        start, at, closing, name, attributes = tag
        if not name:
            continue
        if closing:
            if not open_tags[name]:
                continue
            depth = len(stack) - 1
            while depth and stack[depth].tag != name:
                if name not in BLOCKS and stack[depth].tag in BLOCKS:
                    depth = 0   # the end of an inline element doesn't end blocks
                    break
                depth -= 1
            if depth:
                if name in BLOCKS and not stack[-1].dropped:
                    end_block()
                close(depth)
            continue
        if name == "br" and not stack[-1].dropped:
            piece.append(" ")
        if name in RAW:
            finish = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            at = finish.start() if finish else end
            at = page.find(">", at) + 1 or end
            continue
        if name in BLOCKS and not stack[-1].dropped:
            end_block()
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        if name in ENDS:
            depth = len(stack) - 1
            while depth and stack[depth].tag not in ENDS[name] and stack[depth].tag not in SCOPES:
                depth -= 1
            if depth and stack[depth].tag in ENDS[name]:
                close(depth)
        above = stack[-1]
        path, dropped, suspect, trust = above.path, above.dropped, above.suspect, above.trust
        if not dropped or suspect is not None:
            names = _named(attributes)
            inside = paths.whole[path] >= 0
            if (name in DROPPED and name != "form" or name == "header" and not inside
                    or name not in ("html", "body") and _hidden(names)):
                dropped, suspect = True, None
            elif name == "form" or name not in ("html", "body", "article", "main") and bool(names) and _unwanted(names, inside):
                if start in kept:
                    trust = UNWANTED_TRUST
                else:
                    dropped, suspect = True, _Suspect(start, suspect)
                    suspects.append(suspect)
            if name in BLOCKS and not (dropped and suspect is None):
                path = paths.below(path, name, sorted(re.sub(r"\d+", "#", c) for c in names.get("class", "").split()))
        element = _Element(name, path, dropped, above, len(blocks), suspect, trust)
        links += name == "a"
        if name in CONTAINERS and not dropped:
            found.append(element)
        open_tags[name] += 1
        stack.append(element)
    if not stack[-1].dropped:
        end_block()
    close(0)
    return Page(found or [root], blocks, block_running, paths), suspects, running, whole


def best_path(page):
    """Number and score of the path whose containers score most; an article or main around it stands for it.

    So does the container around it that holds running text at other paths too; one further
    out only if a fifth of its running text is elsewhere.  Of equal scores the path with fewest parts wins, then the first by text.
    """
    scores, running, paths = {}, {}, page.paths
    for box in page.boxes:
        scores[box.path] = scores.get(box.path, 0.0) + box.score
        running[box.path] = running.get(box.path, 0.0) + page.running(box)
    score = max(scores.values())
    tied = [p for p, s in scores.items() if s == score]
    least = min(paths.depth[p] for p in tied)
    tied = [p for p in tied if paths.depth[p] == least]
    path = tied[0] if len(tied) == 1 else min(tied, key=paths.text)
    if paths.whole[path] >= 0:
        return paths.whole[path], score
    above, nearest = paths.parent[path], True
    while above > 0:
        if above in running:
            more = running[above] - running[path]
            if more > (0 if nearest else running[above] / 5):
                path = above
            nearest = False
        above = paths.parent[above]
    return path, score


def text_at(page, path):
    """Blocks of all containers at a path, in page order, each once."""
    kept, done = [], 0
    for box in page.boxes:       # in page order; one may be inside another
        if box.path == path and box.last > done:
            kept += page.blocks[max(box.first, done):box.last]
            done = box.last
    return "\n\n".join(kept)


def extract(page, paths=()):
    """Main text of a page, given the winning paths of its host in order of votes."""
    if not page:
        return ""
    read = containers_of(page)
    own = best_path(read)[0]
    here = read.paths.find(paths)
    if own in here:
        return text_at(read, own)
    # By the score on this page; paths of equal score by votes.
    scores, places = dict.fromkeys(paths, 0.0), {t: n for n, t in here.items()}
    for box in read.boxes:
        if box.path in here:
            scores[here[box.path]] += box.score
    for path in sorted(scores, key=scores.get, reverse=True):
        text = text_at(read, places[path]) if path in places else ""
        if text:
            return text
    return text_at(read, own)


def _votes(batches):
    held = {}

    def flush():
        out = pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in held], pa.string()), pa.array([p for _, p in held], pa.string()),
             pa.array(list(held.values()), pa.int64())], ["host", "path", "votes"])
        held.clear()
        return out

    for batch in batches:
        for host, page in zip(batch.column(0), batch.column(1)):
            page = page.as_py()
            if page:
                read = containers_of(page)
                path, score = best_path(read)
                if score > 0:
                    key = (host.as_py(), read.paths.text(path))
                    held[key] = held.get(key, 0) + 1
                    if len(held) >= HELD_VOTES:
                        yield flush()
    yield flush()


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages, share=SHARE):
    """host, paths: the winning paths of every host, by votes."""
    votes = (with_package(pages).select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string, votes long")
             .groupBy("host", "path").agg(F.sum("votes").alias("votes")))
    all_of = votes.groupBy("host").agg(F.sum("votes").alias("all"))
    winners = votes.join(all_of, "host").filter(F.col("votes") >= share * F.col("all"))
    return winners.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("order"), "path")))
                                       .alias("ordered")).select("host", F.col("ordered.path").alias("paths"))


def _extracted(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            cut = batch.slice(at, 64)
            texts = [extract(page.as_py(), paths.as_py() or ()) for page, paths in zip(cut.column(2), cut.column(3))]
            yield pa.RecordBatch.from_arrays(
                [cut.column(0), cut.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])


def main_texts(pages, share=SHARE):
    """page_id, url, text, n_chars: one row per page."""
    paths = stored(host_paths(pages, share), "host-paths")
    columns = with_package(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                           F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    return columns.join(paths, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(
        _extracted, "page_id long, url string, text string, n_chars long")
