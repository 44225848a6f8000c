"""Markdown of one page: a left-to-right fold over its nodes with a stack of open blocks."""

from __future__ import annotations

import re
from collections.abc import Iterable

MARKS = {"b": "**", "strong": "**", "i": "_", "em": "_"}
PARAGRAPHS = frozenset("p div section article main header footer aside nav figure form address body html dl dt dd fieldset".split())
ESCAPED = re.compile(r"([\\*_`\[\]])")
BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
BREAK = "  \n"


class Fold:
    """Finished lines, the open quotes and list items (each the prefix of its lines), and the text of the block at hand."""

    def __init__(self):
        self.lines: list[str] = []
        self.frames: list[list] = []  # [prefix of the first line, prefix of the others, first line is written]
        self.lists: list[list] = []  # [ordered, number of the next item]
        self.text: list[str] = []
        self.marks = 0  # of the parts of the text, those that say nothing by themselves
        self.on: list[tuple[str, int, int]] = []  # emphasis that is open: mark, parts and marks of the text behind it
        self.heading = self.code = self.pre = 0
        self.tables, self.rows, self.cell = 0, [], None

    # --- blocks ---

    def emit(self, block: list[str]) -> None:
        if self.lines:
            item = next((f for f in self.frames if not f[2] and f[0] != f[1]), None)
            # An item's first line follows the line before it, unless its list begins behind other text outside of all lists.
            if item is None or (item[3] and len(self.lists) == 1):
                self.lines.append("".join(f[1] for f in self.frames if f[2]).rstrip())
        for line in block:
            prefix = "".join(f[1] if f[2] else f[0] for f in self.frames)
            for f in self.frames:
                f[2] = True
            self.lines.append(prefix + line if line else prefix.rstrip())

    def flush(self) -> None:
        """The text at hand becomes a block. Emphasis ends with it and begins anew in the next."""
        if self.cell is not None or len(self.text) == self.marks:
            if self.cell is not None and self.text:
                self.say(" ")
            return
        open_marks = [mark for mark, _, _ in self.on]
        parts = "".join([*self.text, *reversed(open_marks)]).split(BREAK)
        self.text, self.marks = open_marks, len(open_marks)
        self.on = [(mark, i, i) for i, mark in enumerate(open_marks, 1)]
        parts = [p.strip(" ") if 0 < i < len(parts) - 1 else p.lstrip(" ") if i else p for i, p in enumerate(parts)]
        parts[0] = parts[0].lstrip(" ")
        if not "".join(parts).strip(" "):
            return
        if self.heading:
            self.emit(["#" * self.heading + " " + " ".join(p for p in parts if p)])
        else:
            while not parts[-1]:  # a break at the very end breaks nothing
                parts.pop()
            self.emit([p + "  " for p in parts[:-1]] + parts[-1:])

    def say(self, part: str, mark: bool = False) -> None:
        if mark or part == " ":
            self.marks += 1
        self.text.append(part)

    # --- nodes ---

    def data(self, text: str) -> None:
        if self.pre:
            self.text.append(text)
        elif self.tables and self.cell is None:
            return  # between cells
        else:
            text = BLANKS.sub(" ", text)
            self.say(text if self.code else ESCAPED.sub(r"\\\1", text))

    def open(self, tag: str, link: str | None, alt: str | None) -> None:
        if self.pre:
            self.pre += tag == "pre"
            if tag == "br":
                self.text.append("\n")
        elif tag in MARKS:
            self.say(MARKS[tag], mark=True)
            self.on.append((MARKS[tag], len(self.text), self.marks))
        elif tag == "code":
            self.code += 1
            self.say("`", mark=True)
        elif tag == "a" and link is not None:
            self.say("[", mark=True)
        elif tag == "br":
            self.say(" " if self.cell is not None else BREAK)
            self.marks += 0 if self.cell is not None else 1
        elif tag == "img":
            self.text.append(f"![{alt or ''}]({link or ''})")
        elif tag == "table" and self.cell is None:
            if not self.tables:
                self.flush()
                self.rows = []
            self.tables += 1
        elif self.tables and self.cell is None and tag in ("tr", "td", "th", "caption"):
            if tag == "tr":
                self.rows.append([])
            else:
                self.cell, self.text, self.marks, self.on = tag, [], 0, []
        else:
            self._open_block(tag, link)

    def _open_block(self, tag: str, link: str | None) -> None:
        if tag in ("ul", "ol"):
            self.flush()
            if self.cell is None:
                digits = (link or "").strip()
                self.lists.append([tag == "ol", int(digits) if re.fullmatch(r"-?\d{1,9}", digits) else 1, True])
        elif tag == "li":
            self.flush()
            if self.cell is None:
                kind = self.lists[-1] if self.lists else [False, 1, True]
                marker = f"{kind[1]}. " if kind[0] else "- "
                self.frames.append([marker, " " * len(marker), False, kind[2]])
                kind[1], kind[2] = kind[1] + 1, False
        elif tag == "blockquote":
            self.flush()
            if self.cell is None:
                self.frames.append(["> ", "> ", False, False])
        elif tag == "pre":
            self.flush()
            if self.cell is None:
                self.pre, self.text, self.marks, self.on = 1, [], 0, []
        elif tag == "hr":
            self.flush()
            if self.cell is None:
                self.emit(["* * *"])
        elif tag in PARAGRAPHS:
            self.flush()
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.flush()
            self.heading = int(tag[1])

    def close(self, tag: str, link: str | None) -> None:
        if self.pre:
            self.pre -= tag == "pre"
            if not self.pre:
                body = "".join(self.text).strip("\n")
                fence = "`" * max(3, 1 + max(map(len, re.findall("`+", body)), default=0))
                self.text = []
                self.emit([fence, *body.split("\n"), fence])
        elif tag in MARKS:
            mark = MARKS[tag]
            i = next((i for i in reversed(range(len(self.on))) if self.on[i][0] == mark), None)
            _, parts, marks = self.on.pop(i) if i is not None else (mark, 0, -1)
            if len(self.text) - parts == self.marks - marks:  # nothing was emphasised
                del self.text[parts - 1]
                self.marks -= 1
            else:
                self.say(mark, mark=True)
        elif tag == "code":
            self.code -= 1
            self.say("`", mark=True)
        elif tag == "a" and link is not None:
            self.say(f"]({link})", mark=True)
        elif tag == self.cell and self.tables == 1:
            said = BLANKS.sub(" ", "".join(self.text)).strip().replace("|", "\\|")
            self.cell, self.text, self.marks = None, [], 0
            if tag == "caption":
                self.emit([said])
            else:
                if not self.rows:
                    self.rows.append([])
                self.rows[-1].append(said)
        elif tag == "table" and self.cell is None and self.tables:
            self.tables -= 1
            rows = [r for r in self.rows if r]
            if not self.tables and rows:
                width = max(map(len, rows))
                rows = [r + [""] * (width - len(r)) for r in rows]
                rows.insert(1, ["---"] * width)
                self.emit(["| " + " | ".join(r) + " |" for r in rows])
        elif self.cell is None:
            self._close_block(tag)
        elif tag in PARAGRAPHS or tag == "li":
            self.flush()

    def _close_block(self, tag: str) -> None:
        if tag in ("ul", "ol", "li", "blockquote") or tag in PARAGRAPHS:
            self.flush()
        if tag in ("ul", "ol"):
            self.lists.pop()
        elif tag in ("li", "blockquote"):
            if tag == "li" and not self.frames[-1][2]:
                self.emit([""])  # an empty item
            self.frames.pop()
        elif self.heading and tag == f"h{self.heading}":
            self.flush()
            self.heading = 0


def fold(nodes: Iterable[tuple]) -> str:
    """``nodes``: (ord, last, tag or None, text, link: href, src or start, alt) in preorder; gaps are fine."""
    out, opened = Fold(), []
    for at, last, tag, text, link, alt in nodes:
        while opened and opened[-1][0] < at:
            out.close(*opened.pop()[1:])
        if tag is None:
            out.data(text or "")
        else:
            out.open(tag, link, alt)
            opened.append((last, tag, link))
    while opened:
        out.close(*opened.pop()[1:])
    out.flush()
    return "\n".join(out.lines)
