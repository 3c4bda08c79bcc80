"""Patterns of configurations in the dialect of Spark (Java's). The configuration's dialect has neither lookaround nor
backreferences; what the two write alike but read differently is rewritten, and what has no counterpart is refused."""

from __future__ import annotations

import re


class PatternError(ValueError):
    pass


# Bracketed classes, escapes of classes, anchors and letters that both dialects know.
_NAMED = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}",
    "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\s", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}",
}
_CLASSES, _LETTERS, _ANCHORS = "dDsSwW", "aftnr", "bBAz"
_CATEGORIES = re.compile(r"[CLMNPSZ][a-z]?")
_COUNT = re.compile(r"\{\d+(,\d*)?\}")


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at, self.groups, self.out = text, 0, 0, []
        self.lines = False  # whether ^ and $ mean lines

    def stop(self, what: str) -> PatternError:
        return PatternError(f"{what} at character {self.at} of the pattern {self.text}")

    def take(self, n: int = 1) -> str:
        piece = self.text[self.at : self.at + n]
        if len(piece) < n:
            raise self.stop("unexpected end")
        self.at += n
        return piece

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def until(self, end: str) -> str:
        stop = self.text.find(end, self.at)
        if stop < 0:
            raise self.stop(f"missing {end}")
        piece = self.text[self.at : stop]
        self.at = stop + len(end)
        return piece

    def escape(self, inside: bool) -> str:
        c = self.take()
        if c in _CLASSES or c in _LETTERS or c in _ANCHORS and not inside:
            if c == "b" and self.peek() == "{":
                raise self.stop("a special word boundary")
            return "\\" + c
        if c == "v":
            return r"\x0B"
        if c in "xuU":
            digits = self.take() and self.until("}") if self.peek() == "{" else self.take({"x": 2, "u": 4, "U": 8}[c])
            if not re.fullmatch("[0-9A-Fa-f]+", digits) or int(digits, 16) > 0x10FFFF:
                raise self.stop("a bad code point")
            return rf"\x{{{digits}}}"
        if c in "pP":
            name = self.take() and self.until("}") if self.peek() == "{" else self.take()
            c, name = ("P" if c == "p" else "p", name[1:]) if name.startswith("^") else (c, name)
            if not _CATEGORIES.fullmatch(name):
                raise self.stop(f"the property {name}")
            return rf"\{c}{{{name}}}"
        if c.isascii() and not c.isalnum() and c not in "<>":
            return "\\" + c
        raise self.stop(f"the escape \\{c}")

    def bracket(self) -> str:
        """A class in brackets, whose opening one was read."""
        out = "[" + ("^" if self.peek() == "^" and self.take() else "")
        first = True
        while True:
            if self.peek(2) == "[:":
                self.take(2)
                no = self.peek() == "^" and self.take()
                name = self.until(":]")
                if name not in _NAMED:
                    raise self.stop(f"the class {name}")
                out += f"[^{_NAMED[name]}]" if no else _NAMED[name]
            elif self.peek(2) in ("--", "~~") and not first:
                if self.peek(3)[-1] != "]":
                    raise self.stop("a difference of classes")
                out += "\\" + self.take()
            elif (c := self.take()) == "]" and not first:
                return out + "]"
            elif c == "[":
                out += self.bracket()
            elif c == "\\":
                out += self.escape(True)
            else:
                out += "\\" + c if c in "]^#" or c == "&" and self.peek() != "&" and out[-1] != "&" else c
            first = False

    def group(self) -> tuple[str, bool]:
        """What opens a group, after its bracket, and whether a body follows."""
        if self.peek() != "?":
            self.groups += 1
            return "(", True
        self.take()
        if self.peek(2) == "P<" or self.peek() == "<" and self.peek(2) not in ("<=", "<!"):
            self.take(2 if self.peek() == "P" else 1)
            name = self.until(">")
            if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.\[\]]*", name):
                raise self.stop("a bad group name")
            self.groups += 1
            return "(", True  # groups are taken by number
        flags = re.match("[a-zA-Z-]*", self.text[self.at :])[0]
        self.take(len(flags))
        end = self.take()
        if end not in ":)" or set(flags) - set("imsux-") or flags.count("-") > 1 or end == ")" and not flags:
            raise self.stop("lookaround, or a group that the dialect lacks")
        on, _, off = flags.partition("-")
        if "x" in on or "m" in flags and end == ":":
            raise self.stop("a flag that is not supported")
        self.lines = self.lines or "m" in on
        # the dialect is Unicode throughout; the flag u means something else here
        on, off = on.replace("u", ""), off.replace("u", "")
        kept = on + (f"-{off}" if off else "")
        return (f"(?{kept}:", True) if end == ":" else (f"(?{kept})" if kept else "", False)

    def run(self) -> str:
        open_, can_repeat = 0, False
        while self.at < len(self.text):
            c = self.take()
            if c == "(":
                begin, body = self.group()
                self.out.append(begin)
                open_ += body
                can_repeat = False
            elif c == ")":
                open_ -= 1
                if open_ < 0:
                    raise self.stop("a bracket too many")
                self.out.append(c)
                can_repeat = True
            elif c in "*+?" or c == "{":
                if not can_repeat:
                    raise self.stop("nothing to repeat")
                count = c
                if c == "{":
                    m = _COUNT.match(self.text, self.at - 1)
                    if not m:
                        raise self.stop("a bad count")
                    count = m[0]
                    self.at += len(count) - 1
                self.out.append(count + (self.take() if self.peek() == "?" else ""))
                if self.peek() and self.peek() in "*+?" or _COUNT.match(self.text, self.at):
                    raise self.stop("a repetition of a repetition")
                can_repeat = False
            elif c == "$":
                self.out.append("$" if self.lines else r"\z")
                can_repeat = False
            elif c in "|^":
                self.out.append(c)
                can_repeat = False
            else:
                self.out.append(self.bracket() if c == "[" else self.escape(False) if c == "\\" else "\\" + c if c in "]}" else c)
                can_repeat = True
        if open_:
            raise self.stop("a bracket too few")
        return "(?d)" + "".join(self.out)  # only \n ends a line


def translated(text: str) -> tuple[str, int]:
    """The pattern in Spark's dialect, and its number of groups."""
    reader = _Reader(text)
    return reader.run(), reader.groups
