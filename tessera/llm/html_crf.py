"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the stretches of text between block-level tags.  Each block has
features of its ancestors (tags, tokens of class, id and role, their share of the page's prose), of
its text and of its neighbours; a two-label chain (main text or not) is trained by maximum
likelihood on labelled pages and decoded by Viterbi.  No name decides alone: the labelled pages name
their main part after anything, or not at all.
"""

from __future__ import annotations

import html
import pickle
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lean, small_batches

_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the start of another ends.
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"}}
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_SCOPE = frozenset("table ul ol dl select html body div article section nav aside footer header main form".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
_END = re.compile(r"[.!?…:;\"”»)]$")
_STOP = re.compile(r"[.!?…](?:\s|$)")
_DATE = re.compile(r"\d{4}|\d:\d\d")
#: Elements that hold text rather than blocks.
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption label button option summary".split())


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order: references decoded, white space runs one space.

    ``path`` holds (tag, tokens, number) of the open elements, numbers by their start.  Broken markup is read as it stands: what is
    left open stays open, an end tag without a start is skipped, an unended tag or comment runs on.
    """
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, tuple[str, ...], int]] = []
    parts: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(stack), min(linked, len(text))))
            parts.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            run = page[at : m.start()]
            parts.append(run)
            if in_link:
                linked += len(run)
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            if m[1]:
                flush()
            continue
        tag, end, rest = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if end else 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        in_link = 0
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        ended = _ENDS.get(tag, {"p"} if tag in _CLOSES_P else ())
        while stack and stack[-1][0] in ended:
            stack.pop()
        if tag in _VOID:
            continue
        names: tuple[str, ...] = ()
        if "=" in rest or "hidden" in rest:
            found = [t for x in _NAMED.findall(rest) for t in _SPLIT.split(" ".join(x)) if t]
            names = tuple(dict.fromkeys(t.lower() for t in found)) + (("hidden",) if _HIDDEN.search(rest) else ())
        stack.append((tag, names, m.start()))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def _share(part: int, whole: int) -> int:
    """0 to 4: none, under an eighth, under a third, under two thirds, more."""
    return 0 if not part else 1 if 8 * part < whole else 2 if 3 * part < whole else 3 if 3 * part < 2 * whole else 4


def features(page: list[Block]) -> list[list[str]]:
    """Feature names of each block."""
    n = len(page)
    words = [b.text.count(" ") + 1 for b in page]
    linked = [round(3 * b.linked / len(b.text)) for b in page]
    ends = [bool(_END.search(b.text)) for b in page]
    prose = [w if w >= 8 and e and not k else 0 for w, k, e in zip(words, linked, ends, strict=True)]
    total = sum(prose)
    inside: dict[tuple, int] = {}  # prose words in an element, by its path
    for b, w in zip(page, prose, strict=True):
        if w:
            for k in range(1, len(b.path) + 1):
                inside[b.path[:k]] = inside.get(b.path[:k], 0) + w
    known: dict[tuple, list[str]] = {}
    out = []
    for i, b in enumerate(page):
        above = known.get(b.path)
        if above is None:
            named = [(t, names) for t, names, _ in b.path]
            tags, tokens = {t for t, _ in named}, {x for _, names in named for x in names}
            box = b.path[:-1] if b.path and b.path[-1][0] in _LEAVES else b.path
            up = [_share(inside.get(box[: max(1, len(box) - k)], 0), total) for k in range(3)]
            near = {x for _, names in named[-2:] for x in names}
            known[b.path] = above = [
                "bias", f"parent={named[-1][0] if named else ''}", f"box={box[-1][0] if box else ''}", *(f"in={t}" for t in tags), *(f"token={x}" for x in tokens), *(f"near={x}" for x in near),
                *(f"prose{k}={v}" for k, v in enumerate(up)), f"depth={min(6, len(b.path))}", f"list={'li' in tags}",
            ]
        t = b.text
        size = min(6, words[i].bit_length())
        f = [*above, f"words={size}", f"linked={linked[i]}", f"ends={ends[i]},{size > 3}", f"stops={min(3, len(_STOP.findall(t)))}", f"place={5 * i // n}"]
        for name, k in (("before", i - 1), ("after", i + 1)):
            if 0 <= k < n:
                same = page[k].path == b.path or page[k].path[:-1] == b.path[:-1]
                f += [f"{name}={min(6, words[k].bit_length())},{linked[k] > 1}", f"{name} parent={page[k].path[-1][0] if page[k].path else ''}", f"{name} prose={prose[k] > 0},{same}"]
            else:
                f.append(f"{name}=none")
        if "©" in t:
            f.append("copyright")
        if len(t) < 40 and _DATE.search(t):
            f.append("date")
        if prose[i]:
            f.append("prose")
        out.append(f)
    return out


class Chain:
    """Two-label linear chain: weights by feature (of the label main), transitions, start."""

    def __init__(self, weights: dict[str, float], transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions

    def decode(self, page: list[list[str]]) -> list[bool]:
        """Viterbi labels."""
        if not page:
            return []
        get, ((t00, t01), (t10, t11)) = self.weights.get, self.transitions.tolist()
        back, a, b = [], 0.0, 0.0
        for k, f in enumerate(page):
            s = sum(get(x, 0.0) for x in f)
            if k:
                from0, from1 = a + t00 < b + t10, a + t01 < b + t11
                back.append((from0, from1))
                a, b = (b + t10 if from0 else a + t00), (b + t11 if from1 else a + t01) + s
            else:
                b = s
        at = b > a
        labels = [at]
        for from0, from1 in reversed(back):
            at = from1 if at else from0
            labels.append(at)
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[bool]]], rounds: int = 150, rate: float = 0.15, ridge: float = 0.02) -> Chain:
    """Maximum likelihood with a ridge, by Adam on exact forward-backward gradients over all pages at once."""
    index: dict[str, int] = {}
    seen: dict[str, int] = {}
    for fs, _ in pages:
        for f in fs:
            for x in f:
                seen[x] = seen.get(x, 0) + 1
    for x, n in seen.items():
        if n >= 3:
            index[x] = len(index)
    longest, count = max(len(y) for _, y in pages), len(pages)
    y, live = np.zeros((count, longest), int), np.zeros((count, longest), bool)
    rows: list[list[int]] = []  # the known features of each block, one block after the other
    for p, (fs, labels) in enumerate(pages):
        rows += [[index[v] for v in f if v in index] for f in fs]
        y[p, : len(labels)], live[p, : len(labels)] = labels, True
    flat = np.fromiter((v for row in rows for v in row), np.int64)
    edge = np.cumsum([0, *map(len, rows)])
    of = np.repeat(np.arange(len(rows)), np.diff(edge))
    w, t = np.zeros(len(index)), np.zeros((2, 2))
    state = [np.zeros_like(v) for v in (w, w, t, t)]
    for step in range(1, rounds + 1):
        unary = np.zeros((count, longest, 2))
        unary[:, :, 1][live] = np.bincount(of, w[flat], len(rows))
        alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
        alpha[:, 0] = unary[:, 0]
        for k in range(1, longest):
            moved = np.logaddexp(alpha[:, k - 1, 0, None] + t[0], alpha[:, k - 1, 1, None] + t[1]) + unary[:, k]
            alpha[:, k] = np.where(live[:, k, None], moved, alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            ahead = unary[:, k + 1] + beta[:, k + 1]
            beta[:, k] = np.where(live[:, k + 1, None], np.logaddexp(t[:, 0] + ahead[:, 0, None], t[:, 1] + ahead[:, 1, None]), 0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        main = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None])
        gw = np.bincount(flat, (y - main)[live][of], len(index)) / count - ridge * w / 10
        pair = np.exp(alpha[:, :-1, :, None] + t + (unary + beta)[:, 1:, None, :] - total[:, None, None, None])
        pair[~live[:, 1:]] = 0
        gt = -pair.sum(axis=(0, 1))
        np.add.at(gt, (y[:, :-1][live[:, 1:]], y[:, 1:][live[:, 1:]]), 1)
        gt = gt / count - ridge * t
        for v, g, m, s in ((w, gw, state[0], state[1]), (t, gt, state[2], state[3])):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Chain({f: round(float(w[i]), 6) for f, i in index.items()}, np.round(t, 6))


#: Names that pages give to their parts.
MAIN_NAMES = "content article post entry story body text main page blog prose single".split()
SIDE_NAMES = {
    "advert": "ad ads advert advertisement adsense sponsored sponsor banner promo promoted".split(),
    "notice": "cookie consent notice alert gdpr popup modal overlay warning disclaimer message".split(),
    "comments": "comments comment commentlist disqus discussion replies reply respond responses".split(),
    "sidebar": "sidebar side widget related recommended recommendations more popular trending aside teaser".split(),
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs pagination pager topbar toolbar tabs skip links".split(),
    "header": "header masthead logo branding sitename tagline hero top".split(),
    "footer": "footer copyright bottom colophon legal credits imprint".split(),
    "form": "form search login signup subscribe newsletter register contact feedback".split(),
    "share": "share social sharing follow tags meta buttons".split(),
}
#: Names that say nothing: of layout.
LAYOUT_NAMES = "wrapper wrap container row col inner outer grid flex box block section group layout site app root td ss cell panel region".split()
_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wo xi yu".split()


class Drawn:
    """An invented page with labels: markup of known parts, each leaf's label noted as it is drawn."""

    def __init__(self, seed: int):
        self.r, self.out, self.labels = random.Random(seed), [], []

    def words(self, n: int) -> str:
        return " ".join("".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 3))) for _ in range(n))

    def prose(self, n: int) -> str:
        """Sentences of some ten words, ``n`` words in all."""
        out = []
        while n > 0:
            k = min(n, self.r.randint(5, 16))
            out.append(self.words(k).capitalize() + self.r.choice([".", ".", ".", ".", ".", "?", "!", ".***", ".##"]))
            n -= k
        return " ".join(out)

    def leaf(self, tag: str, n: int, main: bool, link: bool = False, prose: bool = False) -> None:
        text = self.prose(n) if prose else self.words(n)
        text = f"<b>{text}</b>" if self.r.random() < 0.05 else text
        if main and prose and n > 12 and self.r.random() < 0.15:
            text += f' <a href="/y">{self.words(2)}</a>.'
        self.out.append(f"<{tag}>" + (f'<a href="/x">{text}</a>' if link else text) + f"</{tag}>")
        self.labels.append(main)

    def name(self, known: list[str], plain: float) -> str:
        """An attribute of a name out of ``known``, or (share ``plain``) of one that says nothing, or none."""
        r = self.r
        if r.random() < plain:
            word = r.choice(["", r.choice(LAYOUT_NAMES), f"{r.choice(LAYOUT_NAMES)}-{r.choice(LAYOUT_NAMES)}", f"col-{r.randint(1, 12)}", "".join(r.choice(_SYLLABLES) for _ in range(3))])
        else:
            word = r.choice(["", "", "site-", "page-", "main-", "post-", "article-"]) + r.choice(known) + r.choice(["", "", "-box", "-wrap", "s", "_1", "-area"])
        return f' {r.choice(["class", "id", "class"])}="{word}"' if word else ""

    def side(self, kind: str) -> None:
        r = self.r
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind, "div")
        own = tag != "div" and r.random() < 0.6
        tag = tag if own else r.choice(["div", "section", "ul"]) if kind == "menu" else r.choice(["div", "section"])
        sure = kind in ("menu", "form", "footer", "share")  # what it holds tells it, too
        self.out.append(f"<{tag}{self.name(SIDE_NAMES[kind], 0.5 if own else 0.25 if sure else 0.0)}>")
        deep = r.randint(0, 2) if r.random() < 0.4 else 0
        self.out += [f"<div{self.name(SIDE_NAMES[kind], 0.7)}>" for _ in range(deep)]
        if kind == "menu" or (kind in ("sidebar", "footer", "share") and r.random() < 0.5):
            self.out.append("<ul>")
            for _ in range(r.randint(2, 7)):
                self.leaf("li", r.randint(1, 3), False, link=True)
            self.out.append("</ul>")
        elif kind == "footer":
            self.out.append("&copy; ")
            self.labels.append(False)
            self.out.append(self.words(r.randint(2, 18)) + r.choice(["", ".", ". " + self.words(4) + "."]))
        elif kind == "advert" or kind == "notice" or (kind == "header" and r.random() < 0.5):
            if r.random() < 0.5:
                self.out.append(self.words(r.randint(2, 14)).capitalize() + r.choice([".", ".", "", "!"]))
                self.labels.append(False)
            else:
                self.leaf("p", r.randint(2, 16), False, prose=True)
        elif kind == "form":
            for _ in range(r.randint(1, 3)):
                self.leaf("label", r.randint(1, 3), False)
            self.leaf(r.choice(["button", "p"]), r.randint(1, 6), False)
        elif kind == "comments":
            for _ in range(r.randint(1, 5)):
                end = r.choice(["div", "div", "li"])
                self.out.append(f"<{end}{r.choice([' class=comment', '', ''])}>")
                self.leaf(r.choice(["h4", "div", "span"]), 2, False) if r.random() < 0.8 else None
                for _ in range(r.choice([1, 1, 1, 2])):
                    self.leaf("p", r.randint(2, 45), False, prose=True)
                self.out.append(f"</{end}>")
        else:
            self.leaf(r.choice(["h1", "h3", "h4"]), r.randint(1, 5), False, link=r.random() < 0.3)
            for _ in range(r.randint(0, 3)):
                self.leaf("p", r.randint(2, 25), False, link=r.random() < 0.4, prose=r.random() < 0.6)
        self.out += ["</div>"] * deep
        self.out.append(f"</{tag}>")

    def main(self) -> None:
        r = self.r
        tag = r.choice(["article", "article", "main", "div", "div", "section", "td"])
        said = r.random()
        names = SIDE_NAMES[r.choice(["sidebar", "header"])] if tag in ("article", "main") and said < 0.15 else MAIN_NAMES
        self.out.append(("<table><tr>" if tag == "td" else "") + f"<{tag}{self.name(names, 0.6)}>")
        deep = r.randint(0, 2) if r.random() < 0.4 else 0
        self.out += [f"<div{self.name(MAIN_NAMES, 0.8)}>" for _ in range(deep)]
        if r.random() < 0.85:
            self.leaf(r.choice(["h1", "h1", "h2"]), r.randint(2, 14), True, prose=r.random() < 0.4)
        for _ in range(r.randint(1, 12)):
            x = r.random()
            if x < 0.72:
                self.leaf("p", r.choice([r.randint(1, 5), r.randint(6, 30), r.randint(20, 90)]), True, prose=True)
            elif x < 0.8:
                self.leaf(r.choice(["h2", "h3"]), r.randint(1, 6), True)
            elif x < 0.86:
                self.leaf(r.choice(["blockquote", "pre", "figcaption", "div"]), r.randint(3, 30), True, prose=True)
            elif x < 0.88:
                self.out.append(f"<p>{self.words(2).capitalize()}.*** {self.words(1)}.&&&</p>" * 2)  # a line of signs, twice
                self.labels += [True, True]
            elif x < 0.93:
                self.out.append("<ul>")
                for _ in range(r.randint(2, 4)):
                    self.leaf("li", r.randint(2, 18), True, prose=r.random() < 0.6)
                self.out.append("</ul>")
            else:
                self.side(r.choice(["advert", "share", "sidebar", "form", "notice", "comments"]))
        if r.random() < 0.15:
            self.side("comments")
        self.out += ["</div>"] * deep
        self.out.append(f"</{tag}>" + ("</tr></table>" if tag == "td" else ""))

    def page(self) -> tuple[str, list[bool]]:
        r = self.r
        self.out.append("<!DOCTYPE html><html><head>")
        self.leaf("title", r.randint(2, 10), False)
        self.out.append("<script>var a='<p>';</script></head><body>")
        deep = r.randint(0, 2) if r.random() < 0.5 else 0
        self.out += [f"<div{self.name(MAIN_NAMES, 0.8)}>" for _ in range(deep)]
        for kind in r.sample(["menu", "header", "notice", "advert", "menu", "form"], r.randint(0, 4)):
            self.side(kind)
        if r.random() < 0.97:
            self.main()
        for kind in r.sample(["comments", "sidebar", "footer", "advert", "share", "footer", "form", "notice"], r.randint(0, 4)):
            self.side(kind)
        self.out += ["</div>"] * deep
        self.out.append("</body></html>")
        return "".join(self.out), self.labels


def labelled_pages(n: int = 1200, seed: int = 5) -> list[tuple[list[list[str]], list[bool]]]:
    """Features and labels of ``n`` invented pages; their layouts and names are drawn, their words mean nothing."""
    out = []
    for k in range(n):
        page, labels = Drawn(seed * 1_000_003 + k).page()
        found = blocks(page)
        if len(found) == len(labels):
            out.append((features(found), labels))
    return out


_TRAINED: list[Chain] = []


def default_chain() -> Chain:
    """Trained once a driver process, on labelled_pages()."""
    if not _TRAINED:
        _TRAINED.append(train(labelled_pages()))
    return _TRAINED[0]


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, y in zip(found, chain.decode(features(found)), strict=True) if y)


def extract(pages: DataFrame, html_column: str = "html", keep: list[str] | None = None, chain: Chain | None = None) -> DataFrame:
    """Main text of each page, from its whole markup.

    Returns the columns in ``keep`` (all but the markup and clashing ones by default), then ``text
    string`` (main blocks joined by one newline, empty if none) and ``n_chars long`` (code points).
    Null and empty markup have no text; very long pages are read whole.  Of labels that are as likely
    a block isn't main text.  Repeated rows are read alike; no page depends on another.  A kept column
    called ``text`` or ``n_chars`` must be renamed by the caller; other columns are ignored.  An empty
    table gives no rows.
    """
    spark: SparkSession = pages.sparkSession
    keep = [c for c in pages.columns if c not in {html_column, "text", "n_chars"}] if keep is None else keep
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(pickle.dumps(chain or default_chain()))
    frame = pages.select(F.col(html_column).alias("h"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in frame.schema[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shipped.value)
        for batch in batches:
            texts = [main_text(c.as_py(), model) for c in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*batch.schema.names[1:], "text", "n_chars"])

    made = frame.mapInArrow(lean(run), ", ".join([*kept, "text string, n_chars long"]))
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
