"""Values of object literals in scripts: JSON, and what scripts write beyond it."""

from __future__ import annotations

import re

_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)*", re.S)
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|Infinity|NaN)")
# Words that stand for values, and escapes of one letter.
WORDS = {"true": True, "false": False, "null": None, "undefined": None, "!0": True, "!1": False}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
#: Depth beyond which a literal is none, so that no page exhausts the stack.
DEEPEST = 200


class Literal:
    """Reads one value of ``text`` from ``at``: quotes of either kind or none on keys, trailing commas, comments, hex numbers."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at

    def _skip(self) -> str:
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def _take(self, what: str) -> bool:
        if self._skip() == what:
            self.at += 1
            return True
        return False

    def value(self, depth: int = 0):
        c = self._skip()
        if depth > DEEPEST or not c:
            raise ValueError("no value")
        if c == "{":
            return self._object(depth)
        if c == "[":
            return self._array(depth)
        if c in "\"'`":
            return self._string(c)
        for word, meant in WORDS.items():
            if self.text.startswith(word, self.at) and not re.match(r"[\w$]", self.text[self.at + len(word) : self.at + len(word) + 1]):
                self.at += len(word)
                return meant
        if m := _NUMBER.match(self.text, self.at):
            self.at = m.end()
            digits = m[0]
            return int(digits, 16) if "x" in digits.lower() and "Inf" not in digits else float(digits.replace("Infinity", "inf")) if re.search(r"[.eENI]", digits) else int(digits)
        raise ValueError("no value")

    def _object(self, depth: int) -> dict:
        self.at += 1
        out: dict = {}
        while not self._take("}"):
            c = self._skip()
            if c in "\"'":
                key = self._string(c)
            elif m := re.compile(r"[\w$]+").match(self.text, self.at):
                key, self.at = m[0], m.end()
            else:
                raise ValueError("no key")
            if not self._take(":"):
                raise ValueError("no colon")
            out[key] = self.value(depth + 1)
            if not self._take(",") and self._skip() != "}":
                raise ValueError("no end")
        return out

    def _array(self, depth: int) -> list:
        self.at += 1
        out: list = []
        while not self._take("]"):
            out.append(self.value(depth + 1))
            if not self._take(",") and self._skip() != "]":
                raise ValueError("no end")
        return out

    def _string(self, quote: str) -> str:
        parts, at = [], self.at + 1
        stop = re.compile(rf"[\\{quote}]")
        while m := stop.search(self.text, at):
            parts.append(self.text[at : m.start()])
            if m[0] == quote:
                self.at = m.end()
                text = "".join(parts)
                # two escaped halves of one character
                return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if re.search("[\ud800-\udfff]", text) else text
            c, at = self.text[m.end() : m.end() + 1], m.end() + 1
            if c in "ux" and (code := re.compile(r"[0-9a-fA-F]{4}" if c == "u" else r"[0-9a-fA-F]{2}").match(self.text, at)):
                parts.append(chr(int(code[0], 16)))
                at = code.end()
            else:
                parts.append(ESCAPES.get(c, "" if c == "\n" else c))
        raise ValueError("no end")


def literals(script: str) -> list:
    """The objects and arrays that a script assigns, passes or consists of, outermost ones in order.

    A literal that can't be read is passed over, what lies in it is looked at.
    """
    found, at = [], 0
    begins = re.compile(r"(?:^|[=(,:]|return)\s*([\[{])")
    while m := begins.search(script, at):
        reader = Literal(script, m.start(1))
        try:
            value = reader.value()
        except (ValueError, RecursionError):
            at = m.end()
            continue
        if value:
            found.append(value)
        at = max(reader.at, m.end())
    return found
