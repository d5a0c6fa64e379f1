"""Pages as trees by intervals: elements with the range of text they hold, text as runs in page order.

Elements are numbered as they open; one holds the elements ``node`` to ``last`` and the text pieces after
``pos`` up to ``stop``. So what an element holds is a range of the page, its figures are differences of
running sums, and nothing carries its ancestors: work and memory are linear in the page, however deep it is.

Pages are told apart by ``page_id``; give pages whose ids repeat through :func:`keyed`. A null or empty page has
no rows; elements that are never closed end with the page; an end without a beginning is ignored.
"""

from __future__ import annotations

from collections import Counter
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songsieve.functions import quality as q
from songsieve.functions import text as t

#: Fixed sets of element names.
BLOCKS = "article main section div p li ul ol pre blockquote h1 h2 h3 h4 h5 h6 td tr table body nav footer header aside form".split()
NOISE_TAGS = "script style noscript template svg canvas iframe nav footer header aside form button input select title".split()
VOID = "area base br col embed hr input link meta source track wbr".split()
#: Elements whose attributes are kept, and fixed parts of attributes that mark the card of a search result.
WITH_ATTRS = "a img".split()
CARD_TAGS = "li article section div".split()
CARD_PARTS = (("class", "result"), ("class", "card"), ("data-testid", "result"))
#: Fixed parts of attributes that mark page furniture, and of styles that hide.
NOISE_PARTS = (("class", "cookie"), ("id", "cookie"), ("class", "banner"), ("class", "advert"), ("id", "advert"), ("class", "social"), ("class", "share"), ("class", "comment"))
HIDING = ("display:none", "display: none", "visibility:hidden", "visibility: hidden")
#: Fixed selectors of elements that hold lyrics: attribute, how it is compared, value.
SELECTORS = {
    '[data-lyrics-container="true"]': ("data-lyrics-container", "is", "true"),
    '[data-testid*="lyrics" i]': ("data-testid", "holds", "lyrics"),
    '[data-testid*="lyric" i]': ("data-testid", "holds", "lyric"),
    '[itemprop="lyrics"]': ("itemprop", "is", "lyrics"),
    '[itemprop="text"]': ("itemprop", "is", "text"),
    '[class*="lyrics" i]': ("class", "holds", "lyrics"),
    '[class*="lyric" i]': ("class", "holds", "lyric"),
    '[id*="lyrics" i]': ("id", "holds", "lyrics"),
    '[id*="lyric" i]': ("id", "holds", "lyric"),
    ".lyric-original": ("class", "names", "lyric-original"),
    ".cnt-letra": ("class", "names", "cnt-letra"),
    ".lyrics-content": ("class", "names", "lyrics-content"),
    ".song-lyrics": ("class", "names", "song-lyrics"),
    ".lyric__content": ("class", "names", "lyric__content"),
    ".songtext": ("class", "names", "songtext"),
    ".song-text": ("class", "names", "song-text"),
    ".letra": ("class", "names", "letra"),
    ".letra-original": ("class", "names", "letra-original"),
}
#: Attributes that anything is told by, but links and images.
TELLING = {"class", "id", "itemprop", "type", "style", "hidden", "aria-hidden", "data-testid"} | {k for k, _, _ in SELECTORS.values()}
COMPARED = {"is": lambda value, x: value == x, "holds": lambda value, x: x in value.lower(), "names": lambda value, x: x in value.split()}

#: An element or a text piece; of a piece, ``node`` is its element; ``block``, ``card`` and ``parent`` enclose an
#: element and hold a piece. ``attrs`` are kept of links and images, and the style of cards.
FIELDS = (
    ("kind", pa.string(), "string"), ("node", pa.int32(), "int"), ("last", pa.int32(), "int"), ("parent", pa.int32(), "int"), ("block", pa.int32(), "int"), ("card", pa.int32(), "int"), ("pos", pa.int32(), "int"), ("stop", pa.int32(), "int"),
    ("tag", pa.string(), "string"), ("name", pa.string(), "string"), ("selected", pa.list_(pa.string()), "array<string>"), ("attrs", pa.map_(pa.string(), pa.string()), "map<string,string>"), ("text", pa.string(), "string"), ("in_link", pa.bool_(), "boolean"), ("in_noise", pa.bool_(), "boolean"),
)


class Flat(HTMLParser):
    """Rows of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[tuple[list, str, int, int, bool, bool]] = []
        self.held: Counter = Counter()
        self.n = self.pos = 0

    def inner(self) -> tuple[int, int, int, bool, bool]:
        """(element, block, card, in a link, in noise) where the page stands."""
        if not self.open:
            return 0, 0, 0, False, False
        row, _, *rest = self.open[-1]
        return row[1], *rest

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data("\n")
        if tag in VOID:
            return
        if tag in BLOCKS and self.held["p"]:  # a block ends an open paragraph
            self.handle_endtag("p")
        if tag == "a":  # links hold no links
            self.handle_endtag("a")
        self.n += 1
        node, block, card, link, noise = self.inner()
        values = {k: v or "" for k, v in reversed(attrs)}
        named, selected, noise, is_card = "", [], noise or tag in NOISE_TAGS, tag in CARD_TAGS
        if not TELLING.isdisjoint(values):  # most tags say nothing of this, links above all
            named = " ".join(values[k] for k in values if k in ("class", "id", "itemprop") or k == "type" and tag == "script")
            lowered = {k: values[k].lower() for k in ("class", "id", "style") if k in values}
            noise = noise or "hidden" in values or values.get("aria-hidden") == "true"
            noise = noise or any(part in lowered.get(k, "") for k, part in NOISE_PARTS) or any(x in lowered.get("style", "") for x in HIDING)
            selected = [s for s, (k, how, x) in SELECTORS.items() if k in values and COMPARED[how](values[k], x)]
            is_card = is_card or any(part in values.get(k, "").lower() for k, part in CARD_PARTS)
        attrs = list(values.items()) if tag in WITH_ATTRS else [("style", values["style"])] if is_card and "style" in values else None
        row = ["e", self.n, None, node, block, card, self.pos, None, tag, named, selected, attrs, None, link, noise]
        self.rows.append(row)
        self.open.append((row, tag, self.n if tag in BLOCKS else block, self.n if is_card else card, link or tag == "a", noise))
        self.held[tag] += 1
        if tag == "img":  # holds nothing
            self.end_last()

    def handle_endtag(self, tag):
        if not self.held[tag]:
            return
        while True:
            name = self.end_last()
            if name == tag:
                return

    def end_last(self) -> str:
        row, name, *_ = self.open.pop()
        row[2], row[7] = self.n, self.pos
        self.held[name] -= 1
        return name

    def handle_data(self, data):
        self.pos += 1
        node, block, card, link, noise = self.inner()
        self.rows.append(["t", node, None, node, block, card, self.pos, None, self.open[-1][1] if self.open else "", None, None, None, data, link, noise])

    def read(self, html: str) -> None:
        """Take in a whole page. No tag ends after the last ``>``, so what follows it is text and not searched for tags."""
        cut = html.rfind(">") + 1
        self.feed(html[:cut])
        self.close()
        if cut < len(html):
            self.handle_data(unescape(html[cut:]))
        while self.open:
            self.end_last()


def keyed(pages: DataFrame) -> DataFrame:
    """The pages with a column ``key``, equal only where both id and html are."""
    return pages.withColumn("key", F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.md5(F.coalesce("html", F.lit("")).cast("binary"))))


#: Rows from which the pages read so far are passed on together.
BATCH_ROWS = 4096


def nodes(pages: DataFrame) -> DataFrame:
    """Elements and text pieces of all pages (page_id, html)."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def made(ids, rows, id_type):
        columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *[pa.array(c, f[1]) for c, f in zip(columns, FIELDS, strict=True)]], names=["page_id", *[f[0] for f in FIELDS]])

    def run(batches):
        for b in batches:
            ids, rows, id_type = [], [], b.schema.field(0).type
            for page, html in zip(b.column(0), b.column(1), strict=True):
                flat = Flat()
                flat.read(html.as_py() or "")
                ids += [page.as_py()] * len(flat.rows)
                rows += flat.rows
                if len(rows) >= BATCH_ROWS:
                    yield made(ids, rows, id_type)
                    ids, rows = [], []
            yield made(ids, rows, id_type)

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, " + ", ".join(f"{name} {sql}" for name, _, sql in FIELDS))


def runs(flat: DataFrame) -> DataFrame:
    """(page_id, run, block, at, text, gap, chars, lines, link_chars): stretches of text of one block, without noise, in page order.

    Runs are numbered from 1 and begin at the piece ``at``. The text of any range of runs is their texts
    with ``gap`` line ends before each but the first, so its length is a difference of running sums.
    """
    by_pos = Window.partitionBy("page_id").orderBy("pos")
    pieces = flat.where("kind = 't' and not in_noise").select("page_id", "pos", "block", F.translate("text", "\u00a0", " ").alias("text"), "in_link")
    pieces = pieces.withColumn("new", (~F.col("block").eqNullSafe(F.lag("block").over(by_pos))).cast("int")).withColumn("turn", F.sum("new").over(by_pos))
    link = F.sum(F.when(F.col("in_link"), F.length(F.btrim("text", F.lit(" \t\r\n")))).otherwise(0))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "")
    rows = pieces.groupBy("page_id", "turn", "block").agg(F.min("pos").alias("at"), raw.alias("raw"), link.alias("link_chars"))
    ends = lambda c: F.length(F.regexp_replace(c, r"[^\n]", ""))
    rows = rows.select("page_id", "turn", "block", "at", "link_chars", t.lyrics_normalized(F.col("raw")).alias("text"), ends(F.col("raw")).alias("ends"), ends(F.regexp_extract("raw", r"^\s*", 0)).alias("lead"), ends(F.regexp_extract(F.reverse("raw"), r"^\s*", 0)).alias("trail"))
    blank = F.col("text") == ""
    by_turn = Window.partitionBy("page_id").orderBy("turn")
    rows = rows.withColumn("passed", F.sum(F.when(blank, F.col("ends") + 1).otherwise(1)).over(by_turn)).where(~blank)
    gap = F.least(F.lit(3), F.lag("trail").over(by_turn) + F.col("lead") + F.col("passed") - F.lag("passed").over(by_turn)).cast("int")
    return rows.select("page_id", F.row_number().over(by_turn).alias("run"), "block", "at", "text", F.coalesce(gap, F.lit(0)).alias("gap"), F.length("text").alias("chars"), F.size(q.lines(F.col("text"))).alias("lines"), "link_chars")


def measured(flat: DataFrame, text_runs: DataFrame) -> DataFrame:
    """(page_id, node, parent, block, tag, first, final, chars, lines, link_chars, density): block elements outside noise that hold text.

    ``first`` and ``final`` are the first and last run inside, ``block`` the nearest block around. All figures
    are differences of running sums at the element's two ends.
    """
    blocks = flat.where(F.col("tag").isin(BLOCKS) & (F.col("kind") == "e") & ~F.col("in_noise"))
    sums = ("runs", "chars", "lines", "link_chars")
    of_run = text_runs.select("page_id", F.col("at").alias("x"), F.lit(0).alias("turn"), F.lit(None).cast("int").alias("node"), F.lit(1).alias("runs"), (F.col("chars") + F.col("gap")).alias("chars"), "lines", "link_chars")
    of_end = lambda x, turn: blocks.select("page_id", F.col(x).alias("x"), F.lit(turn).alias("turn"), "node", *[F.lit(0).alias(s) for s in sums])
    so_far = Window.partitionBy("page_id").orderBy("x", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = of_run.unionByName(of_end("pos", 1)).unionByName(of_end("stop", 2))
    summed = events.select("page_id", "node", "turn", *[F.sum(s).over(so_far).alias(s) for s in sums]).where("node is not null")
    at = lambda turn, s: F.max(F.when(F.col("turn") == turn, F.col(s)))
    held = summed.groupBy("page_id", "node").agg((at(1, "runs") + 1).cast("int").alias("first"), at(2, "runs").cast("int").alias("final"), *[(at(2, s) - at(1, s)).alias(s) for s in sums[1:]]).where("first <= final")
    gaps = text_runs.select("page_id", F.col("run").alias("first"), "gap")
    out = held.join(gaps, ["page_id", "first"]).withColumn("chars", F.col("chars") - F.col("gap")).drop("gap")
    return out.join(blocks.select("page_id", "node", "parent", "block", "tag"), ["page_id", "node"]).withColumn("density", F.col("link_chars") / F.greatest(F.lit(1), F.col("chars")))


def run_lists(text_runs: DataFrame) -> DataFrame:
    """(page_id, runs): the runs of each page as one list, in order."""
    return text_runs.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("run", "gap", "text"))).alias("runs"))


def text_of(first: Column, final: Column) -> Column:
    """The text of a range of the list ``runs``."""
    part = F.slice("runs", first, final - first + 1)
    return F.array_join(F.transform(part, lambda x, i: F.concat(F.when(i > 0, F.repeat(F.lit("\n"), x["gap"])).otherwise(""), x["text"])), "")


def with_texts(ranges: DataFrame, text_runs: DataFrame) -> DataFrame:
    """The rows (page_id, first, final, ...) with the ``text`` of their range; a range that repeats is assembled once.

    A page's runs meet its ranges as one list: they are shuffled once, and what is put together of them is not.
    """
    others = [c for c in ranges.columns if c not in ("page_id", "first", "final")]
    once = ranges.groupBy("page_id", "first", "final").agg(F.collect_list(F.struct(*others)).alias("of"))
    made = q.once(once.join(run_lists(text_runs), "page_id"), {"text": text_of(F.col("first"), F.col("final"))}).select("page_id", "first", "final", F.explode("of").alias("of"), "text")
    return made.select("page_id", "first", "final", *[F.col("of")[c].alias(c) for c in others], "text")


def pieces_of(flat: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, node, text, link_chars) of any elements (page_id, node, pos, stop), blocks or not, without noise inside."""
    pieces = flat.where("kind = 't' and not in_noise").select("page_id", "pos", "block", "text", "in_link")
    at = wanted.where("stop > pos").select("page_id", "node", F.explode(F.sequence(F.col("pos") + 1, F.col("stop"))).alias("pos"))
    held = at.join(pieces, ["page_id", "pos"])
    new = F.col("block") != F.lag("block").over(Window.partitionBy("page_id", "node").orderBy("pos"))
    held = held.withColumn("text", F.when(new, F.concat(F.lit("\n"), "text")).otherwise(F.col("text")))
    text = t.lyrics_normalized(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), ""))
    link = F.sum(F.when(F.col("in_link"), F.length(F.btrim("text", F.lit(" \t\r\n")))).otherwise(0))
    return held.groupBy("page_id", "node").agg(text.alias("text"), link.alias("link_chars"))
