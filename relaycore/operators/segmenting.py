"""Segments of a payload in Python, for kernels: protected spans and free text, losslessly.

`messages.segments` is the native form, which lacks the JSON test.
"""

import json
import re

TEXT, PROTECTED = "text", "protected"
_FENCE = re.compile(r"^```.*?^```[ \t]*$", re.M | re.S)
BREAK = re.compile(r"\n[ \t]*\n")


def is_structured(paragraph: str) -> bool:
    """A JSON document, or a table: the first two lines begin with a bar."""
    body = paragraph.strip()
    if body[:1] in ("{", "["):
        try:
            json.loads(body)
        except (ValueError, RecursionError):
            return False
        return True
    head = body.splitlines()[:2]
    return len(head) == 2 and all(row.lstrip()[:1] == "|" for row in head)


def _paragraphs(block):
    end = 0
    for gap in BREAK.finditer(block):
        yield block[end : gap.start()]
        yield gap[0]
        end = gap.end()
    yield block[end:]


def split(text: str) -> list[tuple[str, str]]:
    """(kind, text) pairs whose texts join to `text`; gaps between paragraphs are text of their own."""
    found, end = [], 0

    def free(block):
        found.extend((PROTECTED if is_structured(p) else TEXT, p) for p in _paragraphs(block) if p)

    for fence in _FENCE.finditer(text):
        free(text[end : fence.start()])
        found.append((PROTECTED, fence[0]))
        end = fence.end()
    free(text[end:])
    return found


def protected(text: str) -> list[str]:
    return [span for kind, span in split(text) if kind == PROTECTED]


def map_text(text: str, change) -> str:
    """`text` with `change` applied to its free segments."""
    return "".join(span if kind == PROTECTED else change(span) for kind, span in split(text))
