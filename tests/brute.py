"""Plain-Python oracles of the reference behaviour, used on small fixtures.

They are deliberately written differently from the engine (regex splits,
explicit loops) so that agreement means something.
"""

from __future__ import annotations

import re

# Fixed values, stated once more so that a change in the engine shows: words that start a question.
QUESTION_STARTERS = (
    "how", "what", "why", "when", "where", "which", "who", "is", "are",
    "can", "could", "would", "should", "does", "do", "will", "has", "have",
    "any",
)

JAVA_WS = " \t\n\x0b\f\r"


def clean(text):
    if text is None:
        return None
    t = text.lower()
    t = re.sub(rf"http[^{JAVA_WS}]+|www\.[^{JAVA_WS}]+", "", t)
    t = re.sub(rf"[^a-zA-Z0-9{JAVA_WS}?.!]", " ", t)
    t = re.sub(rf"[{JAVA_WS}]+", " ", t)
    return t.strip(" ")


def questions(cleaned):
    if not cleaned:
        return []
    out = []
    for piece in re.split(r"[.!]|(?<=\?)", cleaned):
        s = piece.strip()
        if not s or len(s) <= 15:
            continue
        if s.endswith("?") or s.lower().startswith(QUESTION_STARTERS):
            out.append(s)
    return out


def _after_colon(line):
    return line.split(":", 1)[1].strip()


def qa_lines(text):
    """Q:/A: line format, as a line-by-line state machine."""
    done = []
    state = {"q": None, "a": ""}

    def flush():
        if state["q"] and state["a"]:
            done.append((state["q"], state["a"].strip()))

    for raw in text.split("\n"):
        line = raw.strip()
        if line.startswith(("Q:", "Question:")):
            flush()
            state["q"], state["a"] = _after_colon(line), ""
        elif line.startswith(("A:", "Answer:")):
            state["a"] = _after_colon(line)
        elif state["q"] and line:
            state["a"] = state["a"] + " " + line
    flush()
    return done
