"""The tags of a page, in one forward pass that is linear in the page whatever it holds."""

from __future__ import annotations

import re

#: Elements whose content is not markup.
RAW = {"script", "style", "iframe", "textarea", "title", "noembed", "noframes", "xmp"}


def _end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I)


_END = {name: _end(name) for name in RAW}
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: Up to the end of a tag: quotes count where a value begins.
_INSIDE = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')|[="'])*+""")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


class Tags:
    """A cursor. Nothing behind it is read again: where no ``>`` follows there is no tag any more, and once the quotes of a tag
    run to the end of the page, quotes count no longer in what is left."""

    def __init__(self, page: str):
        self.page, self.at, self.last, self.quotes = page, 0, page.rfind(">"), True

    def next(self) -> tuple[int, str, str, bool] | None:
        """(start, lower-case name, attributes, whether it is an end tag) of the next tag, with an empty name for a comment
        or declaration; the cursor is behind it then. None: only text is left."""
        page = self.page
        at = self.at - 1
        while (at := page.find("<", at + 1)) >= 0:
            if page.startswith(("<!", "<?"), at):
                end, size = ("-->", 4) if page.startswith("<!--", at) else ("]]>", 9) if page.startswith("<![CDATA[", at) else (">", 2)
                stop = page.find(end, at + size)
                self.at = stop + len(end) if stop >= 0 else len(page)
                return at, "", "", False
            if at > self.last:
                return None
            if m := _NAME.match(page, at):
                begin = m.end()
                stop = _INSIDE.match(page, begin).end() if self.quotes else len(page)
                if stop == len(page):
                    self.quotes, stop = False, page.find(">", begin)
                self.at = stop + 1
                return at, m[2].lower(), page[begin:stop], bool(m[1])
        return None

    def raw(self, name: str) -> tuple[int, int]:
        """Begin and end of the content of a raw element whose tag was just read; the cursor goes behind its end tag."""
        begin = self.at
        end = (_END.get(name) or _end(name)).search(self.page, begin)
        if end is None:
            self.at = len(self.page)
            return begin, self.at
        stop = self.page.find(">", end.start())
        self.at = stop + 1 if stop >= 0 else len(self.page)
        return begin, end.start()
