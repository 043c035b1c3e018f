"""Running prose of exported notebooks.

A notebook comes as JSON, as a script with cell markers (``# %%``), or as plain text with
``In [n]:`` and ``Out[n]:`` blocks.  Kept are paragraphs and list entries made of
sentences; left out are code, outputs, tracebacks, images, formulas, headings, tables
and bare lists of words.
"""

from __future__ import annotations

import json
import re
import unicodedata

_CELL = re.compile(r"^# %%(.*)$", re.M)
_PLAIN_CODE = re.compile(r"^(In ?\[|Out ?\[|>>> |-{20,}|Traceback )")
_ERROR = re.compile(r"^[A-Za-z_.]*(Error|Exception|Warning|Interrupt|Exit)\b\s*(:|$)")
_BULLET = re.compile(r"^\s{0,3}(?:[-*+]|\d{1,3}[.)])\s+")
_SKIP = re.compile(r"^(#{1,6}(\s|$)|\$\$|\||<|!\[|={3,}|-{3,}|\\begin|\\end|#>|%)")
_SYMBOLS = re.compile(r"[=\[\]{}()<>_#|\\/@*+$%^&~`]")


def _cells(text: str) -> list[str] | None:
    """Markdown cells of a notebook in JSON; None if it is not one."""
    try:
        cells = json.loads(text)["cells"]
        found = []
        for c in cells:
            if c.get("cell_type") == "markdown":
                source = c.get("source") or ""
                found.append(source if isinstance(source, str) else "".join(map(str, source)))
        return found
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
        return None


def _scripted(text: str) -> list[str]:
    """Markdown cells of a script with cell markers."""
    parts = _CELL.split(text)
    found = [parts[0]] if parts[0].strip() else []
    for marker, body in zip(parts[1::2], parts[2::2]):
        if "[markdown]" in marker or "[md]" in marker:
            found.append("\n".join(x[2:] if x.startswith("# ") else x[1:] if x.startswith("#") else x for x in body.split("\n")))
    return found


def _word_list(p: str) -> bool:
    """Whether a paragraph only lists words, as in 'Words: a, b, c.'"""
    items = p.partition(":")[2] if ":" in p else p
    parts = [x for x in re.split(r"[,;]", items) if x.strip()]
    return len(parts) >= 4 and sum(len(x.split()) <= 2 for x in parts) >= 0.75 * len(parts)


def _sentences(p: str) -> bool:
    words = p.split()
    return bool(words) and len(_SYMBOLS.findall(p)) <= 0.02 * len(p) and sum(w[0].isalpha() for w in words) >= 0.6 * len(words) and any(x in p for x in ".!?") and not _word_list(p)


def _starts_prose(line: str) -> bool:
    """Whether a line that follows code reads as a sentence."""
    s = _BULLET.sub("", line)
    return s[:1].isupper() and s[-1] in ".!?" and not _ERROR.match(s) and len(s.split()) >= 2 and _sentences(s)


def _paragraphs(text: str, plain: bool) -> list[str]:
    found: list[str] = []
    open_: list[str] = []
    skipping = fenced = False

    def close() -> None:
        if open_:
            p = " ".join(open_)
            if _sentences(p):
                found.append(p)
            open_.clear()

    for line in text.split("\n"):
        s = line.strip()
        if s.startswith("```") or s.startswith("~~~"):
            close()
            fenced = not fenced
        elif fenced:
            continue
        elif not s:
            close()
            skipping = False
        elif skipping and not _starts_prose(s):  # some exports have no empty line after code
            continue
        elif plain and _PLAIN_CODE.match(line):
            close()
            skipping = True  # up to an empty line or a sentence
        elif _SKIP.match(s) or _ERROR.match(s) or line.startswith(("    ", "\t")):
            close()
        elif m := _BULLET.match(line):
            close()
            open_.append(line[m.end() :].strip())
            skipping = False
        else:
            open_.append(s)
            skipping = False
    close()
    return found


def prose(text: str | None) -> list[str]:
    """Paragraphs of running prose, in order."""
    if not text:
        return []
    if not text.isascii():  # full-width and other forms of letters, and characters that are not seen
        text = unicodedata.normalize("NFKC", text)
        text = text.translate({ord(c): None for c in set(text) if unicodedata.category(c) == "Cf"})
    if text.lstrip()[:1] in "{[" and (cells := _cells(text)) is not None:
        return [p for c in cells for p in _paragraphs(c, False)]
    if _CELL.search(text):
        return [p for c in _scripted(text) for p in _paragraphs(c, False)]
    return _paragraphs(text, True)
