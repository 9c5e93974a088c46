"""Cutting a stream into regions one character after the other: brute force for the tests."""

import re

START = re.compile(r"\(|<(?!<)|(?<![^\n\r])BI[\n\r]")
RGB, CMYK = ("RGB", "DeviceRGB", "CalRGB"), ("CMYK", "DeviceCMYK")


def value(header, keys, form):
    return next((m[1] for m in (re.search(rf"/{k}[ \t\n\x0B\f\r\xA0]+{form}", header) for k in keys) if m), "")


def data_length(header):
    w, h, bpc = (int(value(header, k, "([0-9]+)") or 0) for k in (("W", "Width"), ("H", "Height"), ("BPC", "BitsPerComponent")))
    space, coding = value(header, ("CS", "ColorSpace"), "/?([A-Za-z]+)"), value(header, ("F", "Filter"), "/?([A-Za-z]+)")
    if coding not in ("", "None") or bpc not in (0, 8) or not w * h:
        return None
    return w * h * (4 if space in CMYK else 3 if space in RGB else 1)


def literal_end(text, start):
    depth, i = 0, start
    while i < len(text):
        if text[i] == "\\":
            i += 2
            continue
        depth += (text[i] == "(") - (text[i] == ")")
        i += 1
        if not depth:
            return i
    return len(text)


def image_end(text, start):
    head = text.find("\nID\n", start + 3)
    if head < 0:
        return None
    n = data_length(text[start + 3:head])
    if n is None:
        m = re.compile(r"\nEI(?=[\x00- Qq]|\Z)").search(text, head + 4)
        return m.end() if m else len(text)
    end = min(head + 4 + n, len(text))
    return end + 3 if text.startswith("\nEI", end) else end


def cut(text, images=True):
    parts, done, at = [], 0, 0
    while m := START.search(text, at):
        start, end = m.start(), None
        if m[0] == "(":
            end = min(literal_end(text, start), len(text))
        elif m[0] == "<":
            end = text.find(">", start) + 1 or None
        elif images:
            end = image_end(text, start)
        if end is None:
            at = start + 1
            continue
        parts += [text[done:start], text[start:end]]
        done = at = end
    return [*parts, text[done:]]
