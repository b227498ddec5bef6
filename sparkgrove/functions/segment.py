"""Cutting one text: lines into sections, a section into sentences, sentences into pieces.

Plain functions of strings, each a single pass over its input, for use in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Sizes in characters.
LIMIT, OVERLAP, LEAST = 1400, 200, 120

_GAP = re.compile(r"""[.?!](?:["')\]])?(\s+)(?=["'(\[]?[0-9A-Z])""")
_SHORT_FORM = re.compile(r"\b(?:(?:approx|etc|fig|al|cf|dr|no|vs|e\.g|i\.e)|(?-i:[A-Z]))\.$", re.I)


def collapse(text: str) -> str:
    """Every run of white space as one space."""
    return " ".join(text.split())


def tidy(text: str) -> str:
    """One kind of line end, no blanks at line ends, at most one empty line in a row, trimmed."""
    lines = [x.rstrip(" \t") for x in re.split("\r\n?|\n", text)]
    return "\n".join(x for k, x in enumerate(lines) if x or not k or lines[k - 1]).strip()


def sentences(text: str) -> list[str]:
    """Sentences of a text; a cut after an abbreviation or an initial is not made."""
    found: list[str] = []
    open_: list[str] = []
    start = 0
    ends = [(m.start(1), m.end(1)) for m in _GAP.finditer(text)]
    for end, begin in [*ends, (len(text), len(text))]:
        piece = text[start:end]
        start = begin
        open_.append(piece)
        if _SHORT_FORM.search(piece[-12:]):
            continue
        found.append(" ".join(open_).strip())
        open_ = []
    found.append(" ".join(open_).strip())
    return [s for s in found if s]


def pack(parts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    """Sentences packed up to ``limit`` characters; trailing ones of up to ``overlap`` open the next piece."""
    done: list[str] = []
    held: list[str] = []
    size = 0
    for s in parts:
        if held and size + len(s) + 1 > limit:
            done.append(" ".join(held))
            at, size = len(held), 0
            while at and size + len(held[at - 1]) <= overlap:
                at -= 1
                size += len(held[at]) + 1
            held = held[at:]
        held.append(s)
        size += len(s) + 1
    if held:
        done.append(" ".join(held))
    return done


Heading = tuple[int, str]


def _run(text: str, sign: str) -> int:
    return len(text) - len(text.lstrip(sign))


def _shallow(line: str) -> bool:
    """Whether a line is indented by no more than three characters."""
    return len(line) - len(line.lstrip()) <= 3


def is_fence(line: str) -> bool:
    return line.lstrip()[:3] in ("```", "~~~") and _shallow(line)


def wiki_heading(line: str) -> Heading | None:
    """As many signs before a name as after it, two at least; what is more on one side belongs to the name."""
    bare = line.strip()
    level = min(_run(bare, "="), _run(bare[::-1], "="), (len(bare) - 1) // 2)
    return (level, bare[level:-level].strip()) if level > 1 else None


def heading(line: str) -> Heading | None:
    """Level and name of a Markdown or wiki heading."""
    bare = line.strip()
    if bare.startswith("=="):
        return wiki_heading(bare)
    level = _run(bare, "#")
    rest = bare[level:]
    if not 1 <= level <= 6 or not rest[:1].isspace() or not _shallow(line):
        return None
    name = rest.strip()
    return level, name.rstrip("#").rstrip() or name[0]


Section = tuple[list[str], str]


def sections(text: str) -> Iterator[Section]:
    """(path, body) in order; headings in fenced code are body, blank bodies are left out."""
    stack: list[Heading] = []
    body: list[str] = []
    fenced = False
    for line in [*text.split("\n"), None]:
        found = None
        if line is not None:
            fence = is_fence(line)
            fenced ^= fence
            found = None if fence or fenced else heading(line)
        if line is not None and found is None:
            body.append(line)
            continue
        if any(x.strip() for x in body):
            yield [name for _, name in stack], "\n".join(body)
        if found:
            stack = [h for h in stack if h[0] < found[0]] + [found]
        body = []


def pieces(title: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[Section]:
    """(path, piece) of a document, without its own title in front of the path.

    Pieces under ``least`` characters go, but a document whose pieces are all short keeps
    its longest one, the first of equals.
    """
    every: list[Section] = []
    own = title.strip().lower()
    for path, body in sections(text):
        inner = path[1:] if path and path[0].lower() == own else path
        every += [(inner, p) for p in pack(sentences(collapse(body)), limit, overlap)]
    kept = [x for x in every if len(x[1]) >= least]
    return kept or ([max(every, key=lambda x: len(x[1]))] if every else [])


_REFERENCE_PARTS = frozenset(("bibliography", "citations", "external links", "further reading", "notes", "references", "see also", "sources"))


def without_reference_parts(text: str) -> str:
    """An encyclopedia article without its level-two sections of references and the like, sub-sections included."""
    kept: list[str] = []
    skip = False
    for line in text.split("\n"):
        if "==" in line and (found := wiki_heading(line)) and found[0] == 2:
            skip = found[1].lower() in _REFERENCE_PARTS
        if not skip:
            kept.append(line)
    return "\n".join(kept)
