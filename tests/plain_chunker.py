"""The chunker as one plain fold over a document's pieces, which the distributed one is held against."""

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate, groupby

from veritide.operators.chunking import MINIMUM, TARGET, estimate

@dataclass(frozen=True)
class Piece:
    """What a chunk is made of: a block, or a part of one."""

    name: str
    kind: str
    text: str
    page: int
    asset: str | None

    @property
    def tokens(self) -> int:
        return estimate(self.text)

    @property
    def whole(self) -> bool:
        """Tables and figures are neither cut nor mixed with what stands beside them."""
        return self.kind in ("table", "figure")


@dataclass(frozen=True)
class Run:
    """Pieces of one section that belong together. ends: the last of its section."""

    pieces: tuple[Piece, ...]
    section: tuple[str, ...]
    ends: bool = False

    @property
    def tokens(self) -> int:
        return sum(p.tokens for p in self.pieces)

    @property
    def whole(self) -> bool:
        return any(p.whole for p in self.pieces)

    @property
    def text(self) -> str:
        return "\n\n".join(p.text for p in self.pieces if p.text).strip()


def runs(section, own, target, overlap):
    """A section's pieces as runs of about the target. A full run's last pieces, as many as the overlap takes, lead the next one too."""
    open_: list[Piece] = []
    for p in own:
        if p.whole:
            lead = open_ if p.kind == "table" and open_ and {x.kind for x in open_} == {"heading"} else []
            if not lead:
                yield Run(tuple(open_), section)
            yield Run((*lead, p), section)
            open_ = []
            continue
        if open_ and sum(x.tokens for x in open_) + p.tokens > target:
            yield Run(tuple(open_), section)
            #: Running sums from the end say how far back the overlap reaches.
            back = list(accumulate(x.tokens for x in reversed(open_)))
            open_ = open_[len(open_) - bisect_right(back, overlap) :]
        open_.append(p)
    yield Run(tuple(open_), section, ends=True)


@dataclass
class Draft:
    """A chunk, as far as it is known."""

    names: list[str]
    text: str
    section: tuple[str, ...]
    pages: tuple[int, int]
    assets: list[str]
    closed: bool

    def take(self, names: list[str], text: str) -> None:
        self.names, self.text = [*self.names, *names], f"{self.text}\n\n{text}"


def settled(all_runs):
    """Runs as chunks: a fold whose state is the chunks so far and the short runs that wait for what follows them.

    A short run goes to the chunk before it, in its own section, or waits. What waits leads the next run if both fit a chunk;
    if not, or if a table or figure comes, it is a chunk by itself.
    """
    out: list[Draft] = []
    waiting: list[Run] = []

    def together() -> tuple[list[str], str]:
        return [p.name for r in waiting for p in r.pieces], "\n\n".join(r.text for r in waiting)

    def pages(r: Run) -> tuple[int, int]:
        return min(p.page for p in r.pieces), max(p.page for p in r.pieces)

    def close() -> None:
        if waiting:
            names, text = together()
            out.append(Draft(names, text, waiting[0].section, pages(waiting[0]), [], False))
            waiting.clear()

    for r in all_runs:
        before = out[-1] if out and not out[-1].closed and out[-1].section == r.section else None
        if r.ends and r.pieces and r.tokens < MINIMUM and before:
            before.take([p.name for p in r.pieces], "\n\n".join(p.text for p in r.pieces))
        elif any(p.text.strip() for p in r.pieces):
            short = estimate(r.text) < MINIMUM and not r.whole
            if short and before:
                before.take([p.name for p in r.pieces], r.text)
            elif short:
                waiting.append(r)
            else:
                if r.whole or sum(estimate(w.text) for w in waiting) + estimate(r.text) > TARGET:
                    close()
                names, text = together()
                shown = [p.asset for p in r.pieces if p.kind == "figure" and p.asset]
                out.append(Draft([*names, *(p.name for p in r.pieces)], "\n\n".join(t for t in (text, r.text) if t), r.section, pages(r), shown, r.whole))
                waiting.clear()
    close()
    return out



def plain_chunks(doc, rows, target, overlap):
    """(chunk_id, block_ids, text, pages, section, assets, tokens) of rows (section, block_id, kind, text, page, asset) in order."""
    made = [(tuple(section or ()), Piece(*row)) for section, *row in rows]
    sections = [(path, [p for _, p in group]) for path, group in groupby(made, key=lambda x: x[0])]
    drafts = settled([r for path, own in sections for r in runs(path, own, target, int(target * overlap))])
    return [(f"{doc}:c{n}", d.names, d.text, d.pages, list(d.section), d.assets, estimate(d.text)) for n, d in enumerate(drafts)]
