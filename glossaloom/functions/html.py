"""Text of html fragments inside documents."""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser


#: Elements whose content is not text.
HIDDEN = ("script", "style", "template")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        self.hidden += tag in HIDDEN

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in HIDDEN))

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def html_text(text: str) -> str:
    """All text of a fragment, without tags, scripts and styles."""
    reader = _Text()
    reader.feed(text)
    reader.close()
    return "".join(reader.parts)


def strip_markup(text: str | None) -> str | None:
    """Decode character references if there is ``&``, then drop tags if there is ``<``."""
    if text is None:
        return None
    if "&" in text:
        text = unescape(text.strip())
    return html_text(text) if "<" in text else text
