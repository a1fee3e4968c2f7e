"""CSS selection over HTML: tag, .class, #id, compounds and descent."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Step:
    def __init__(self, text: str):
        self.tag = (re.match(r"[\w*-]+", text) or [""])[0]
        self.classes = set(re.findall(r"\.([\w-]+)", text))
        self.id = (re.findall(r"#([\w-]+)", text) or [None])[0]

    def fits(self, tag: str, attributes: dict) -> bool:
        return self.tag in ("", "*", tag) and (self.id is None or attributes.get("id") == self.id) and self.classes <= set((attributes.get("class") or "").split())


class _Reader(HTMLParser):
    def __init__(self, steps: list[_Step]):
        super().__init__(convert_charrefs=True)
        self.steps, self.stack, self.open, self.found = steps, [], [], []

    def handle_starttag(self, tag: str, attrs) -> None:
        done = self.stack[-1][1] if self.stack else 0
        attributes = dict(attrs)
        hit = False
        # an element matches the last step if the others were met above, in order
        if done >= len(self.steps) - 1 and self.steps[-1].fits(tag, attributes):
            hit = True
        elif done < len(self.steps) - 1 and self.steps[done].fits(tag, attributes):
            done += 1
        if hit:
            self.found.append([])
        if tag not in VOID:
            self.stack.append((tag, done, len(self.found) - 1 if hit else None))
            if hit:
                self.open.append(len(self.found) - 1)

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _, _ in self.stack):
            while self.stack:
                t, _, at = self.stack.pop()
                if at is not None:
                    self.open.remove(at)
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        for i in self.open:
            self.found[i].append(data)


def select_texts(page: str, selector: str) -> list[str]:
    out: list[str] = []
    for one in selector.split(","):
        reader = _Reader([_Step(s) for s in one.split()])
        reader.feed(page)
        reader.close()
        out += [" ".join("".join(x).split()) for x in reader.found]
    return out
