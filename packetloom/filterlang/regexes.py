"""Patterns of the filter language to those of the JVM, whose defaults differ."""

from __future__ import annotations

from packetloom.filterlang.errors import InvalidRhsValue


def to_jvm(pattern: str, of_bytes: bool) -> str:
    """The same search in java.util.regex: $ is the end of the text only, the dot leaves out line feeds only, classes are
    those of Unicode, or of bytes for a pattern on bytes."""
    out, at, in_class = [], 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        if c == "[":
            in_class += 1
        elif c == "]" and in_class:
            in_class -= 1
        elif c == "$" and not in_class:
            out.append(r"\z")
            at += 1
            continue
        elif pattern.startswith("(?", at) and not in_class:
            end = at + 2
            while end < len(pattern) and (pattern[end].isalpha() or pattern[end] == "-"):
                end += 1
            flags = pattern[at + 2 : end]
            if end < len(pattern) and pattern[end] in ":)" and flags and not flags.startswith("P"):
                on, _, off = flags.partition("-")
                if "U" in flags:
                    raise InvalidRhsValue("the flag U (lazy by default) has no counterpart")
                if "R" in flags:
                    raise InvalidRhsValue("the flag R has no counterpart")
                on, off = on.replace("u", ""), off.replace("u", "")
                body = on + ("-" + off if off else "")
                out.append(f"(?{body}{pattern[end]}" if body else ("(?:" if pattern[end] == ":" else ""))
                at = end + 1
                continue
            if pattern.startswith("(?P<", at):
                out.append("(?<")
                at += 4
                continue
        out.append(c)
        at += 1
    return ("(?d)" if of_bytes else "(?d)(?U)") + "".join(out)
