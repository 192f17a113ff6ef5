"""Reads one page: a tree of its elements, the main region, sections that only lead elsewhere, links with what stands around them, contacts."""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser
from itertools import accumulate
from urllib.parse import urljoin, urlsplit

# How much of a page is kept.
TEXT_LIMIT, EXCERPT_LIMIT, LINK_LIMIT, HEADING_LIMIT, CONTEXT_LIMIT, CONTEXT_BEFORE = 60_000, 1200, 1000, 100, 600, 180
# Elements that aren't content; elements that lead around the site; elements that end a word.
HIDDEN_TAGS = {"title", "script", "style", "noscript", "template", "svg", "canvas", "iframe"}
HIDDEN_CLASSES = {"cookie-banner", "cookie-consent", "cookie-notice", "cookies-banner", "osano-cm-window", "grecaptcha-badge", "skip-link", "skip-to-content"}
HIDDEN_IDS = {"cookie-banner", "cookie-consent", "onetrust-banner-sdk", "onetrust-consent-sdk"}
MENU_ROLES = {"navigation", "banner", "contentinfo"}
MENU_CLASSES = {"site-header", "site-footer", "global-header", "global-footer", "footer-widgets", "breadcrumb", "breadcrumbs", "social-share", "share-buttons", "language-switcher"}
MENU_IDS = {"site-header", "site-footer", "footer-widgets"}
BLOCKS = set("address,article,aside,blockquote,br,dd,div,dl,dt,figcaption,figure,footer,h1,h2,h3,h4,h5,h6,header,hr,li,main,ol,p,section,table,td,th,tr,ul".split(","))
CONTENT_IDS, CONTENT_CLASSES = {"main-content", "maincontent", "content"}, {"main-content", "region-content"}
AROUND_LINK = {"li", "p", "dd", "td", "article", "section", "div"}
# Headings of sections that lead elsewhere, the least share of linked text in them, telephone numbers and addresses.
RELATED_HEADING = re.compile(r"(?:related (?:services|programs|resources|pages|links|information|content)|you may also like|topics|keywords|tags)\s*:?", re.I)
RELATED_SHARE = 0.6
PHONE = re.compile(r"(?<!\d)(?:\+?1[ .-]?)?\(?[2-9]\d{2}\)?[ .-]?\d{3}[ .-]\d{4}(?:\s*(?:ext\.?|x)\s*\d{1,6})?(?!\d)", re.I | re.ASCII)
EMAIL_NAME, EMAIL_HOST = re.compile(r"\b[A-Z0-9._%+-]+", re.I | re.ASCII), re.compile(r"@[A-Z0-9.-]+\.[A-Z]{2,}\b", re.I | re.ASCII)

#: Elements without an end, and those that the start of another one ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ENDED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}, "p": BLOCKS - {"br", "td", "th", "tr", "figcaption"}}
#: A start within these ends nothing above them.
BARRIERS = {"table", "td", "th", "ul", "ol", "dl", "body", "html", "main", "article", "section", "div", "button"}


def squeeze(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


class Tree(HTMLParser):
    """The elements in the order of their starts. Of element i: tag[i], attrs[i], up[i] its parent, last[i] the end of the elements within it, and words[first[i]:end[i]] the texts within it, each with the element that it stands in."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.up, self.last, self.first, self.end = ["#page"], [{}], [-1], [0], [0], [0]
        self.words: list[str] = []
        self.of: list[int] = []
        self.open = [0]
        self.named: dict[str, int] = {}  # how many of a name are open
        self.feed(html)
        self.close()
        while self.open:
            self.leave()
        hidden, menus, region, self.hidden, self.menu, self.inner = self.is_hidden, self.is_menu, self.is_region, [False], [0], [False]
        for i in range(1, len(self.tag)):
            p = self.up[i]
            self.hidden.append(self.hidden[p] or hidden(i))
            self.menu.append(self.menu[p] + menus(i))
            self.inner.append(self.inner[p] or region(p))
        #: So many characters, blanks left out, have the texts before each one.
        self.sizes = [0, *accumulate(0 if self.hidden[i] else len(re.sub(r"\s+", "", w)) for i, w in zip(self.of, self.words, strict=True))]

    def leave(self) -> None:
        i = self.open.pop()
        self.named[self.tag[i]] = self.named.get(self.tag[i], 0) - 1
        self.last[i], self.end[i] = len(self.tag), len(self.words)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        k = len(self.open) - 1
        while k > 0:
            above = self.tag[self.open[k]]
            if tag in ENDED_BY.get(above, ()):
                while len(self.open) > k:
                    self.leave()
            elif above in BARRIERS:
                break
            k -= 1
        i = len(self.tag)
        self.tag.append(tag)
        self.attrs.append({k: v or "" for k, v in reversed(attrs)})
        self.up.append(self.open[-1])
        self.first.append(len(self.words))
        self.last.append(i + 1)
        self.end.append(len(self.words))
        if tag not in VOID:
            self.open.append(i)
            self.named[tag] = self.named.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.named.get(tag, 0) > 0:
            while True:
                done = self.tag[self.open[-1]]
                self.leave()
                if done == tag:
                    break

    def handle_data(self, data: str) -> None:
        self.words.append(data)
        self.of.append(self.open[-1])

    def classes(self, i: int) -> set[str]:
        return set(self.attrs[i].get("class", "").split())

    def is_hidden(self, i: int) -> bool:
        a = self.attrs[i]
        notice = a.get("role") == "dialog" and "cookie" in a.get("aria-label", "").lower()
        return self.tag[i] in HIDDEN_TAGS or "hidden" in a or "inert" in a or a.get("aria-hidden") == "true" or notice or bool(self.classes(i) & HIDDEN_CLASSES) or a.get("id") in HIDDEN_IDS

    def is_menu(self, i: int) -> bool:
        a = self.attrs[i]
        return self.tag[i] == "nav" or a.get("role") in MENU_ROLES or a.get("aria-label", "").lower() == "breadcrumb" or bool(self.classes(i) & MENU_CLASSES) or a.get("id") in MENU_IDS

    def is_main(self, i: int) -> bool:
        return self.tag[i] == "main" or self.attrs[i].get("role") == "main"

    def is_region(self, i: int) -> bool:
        return self.is_main(i) or self.tag[i] == "article"

    def within(self, i: int) -> range:
        return range(i, self.last[i])

    def above(self, i: int):
        while i >= 0:
            yield i
            i = self.up[i]

    def text(self, i: int, without=lambda _: False, breaks: bool = True) -> str:
        """What element i says, hidden parts and elements that `without` holds for left out; breaks: the starts and ends of blocks end words."""
        out, at, skip = [], self.first[i], self.skipped(i, without)
        if i in skip:
            return ""
        marks: list[tuple[int, int]] = []  # places among the words where something begins or ends, and what is left out from there
        for k in self.within(i):
            if k in skip:
                marks.append((self.first[k], self.end[k]))
            elif breaks and k != i and self.tag[k] in BLOCKS:
                marks += [(self.first[k], -1), (self.end[k], -1)]
        for place, to in sorted(marks):
            if place >= at:
                out += self.words[at:place]
                at = place
            if to < 0 or breaks:
                out.append(" ")
            at = max(at, to)
        return squeeze("".join([*out, *self.words[at : self.end[i]]]))

    def skipped(self, i: int, without) -> set[int]:
        """The outermost elements within i that are hidden or left out."""
        out, k = set(), i
        while k < self.last[i]:
            if self.hidden[k] or (k != i and without(k)):
                out.add(k)
                k = self.last[k]
            else:
                k += 1
        return out

    def elements(self, *tags: str):
        return (i for i in range(1, len(self.tag)) if self.tag[i] in tags)

    # the main region

    def has_content(self, i: int) -> bool:
        """Whether anything is said in i outside the menus within it."""
        base = self.menu[i]
        skip = self.skipped(i, lambda k: self.menu[k] > base)
        total = self.sizes[self.end[i]] - self.sizes[self.first[i]]
        return not self.hidden[i] and total > sum(self.sizes[self.end[k]] - self.sizes[self.first[k]] for k in skip)

    def regions(self) -> list[int]:
        """The elements of the first kind of which any has content: main elements, articles, an element named as content, the body, the page."""
        outer = lambda test: [i for i in range(1, len(self.tag)) if test(i) and not self.hidden[i] and not any(test(p) for p in self.above(self.up[i]))]
        named = [i for i in range(1, len(self.tag)) if not self.hidden[i] and (self.attrs[i].get("id") in CONTENT_IDS or self.classes(i) & CONTENT_CLASSES)][:1]
        for found in (outer(self.is_main), outer(lambda i: self.tag[i] == "article"), named, list(self.elements("body"))[:1]):
            if any(map(self.has_content, found)):
                return found
        return [0]

    def related(self, regions: list[int]) -> set[int]:
        """Headings of sections that lead elsewhere, and the elements up to the next heading of that level, where their text is mostly links."""
        out: set[int] = set()
        for h in (k for r in regions for k in self.within(r) if re.fullmatch("h[2-6]", self.tag[k]) and not self.hidden[k]):
            if not RELATED_HEADING.fullmatch(self.text(h, breaks=False)):
                continue
            section, k = [], self.last[h]
            while k < self.last[self.up[h]]:
                if re.fullmatch("h[1-6]", self.tag[k]) and self.tag[k] <= self.tag[h]:
                    break
                section.append(k)
                k = self.last[k]
            total = len(squeeze(" ".join(self.text(k, breaks=False) for k in section)))
            linked = sum(len(self.text(a, breaks=False)) for k in section for a in self.within(k) if self.tag[a] == "a" and not self.hidden[a])
            if linked and linked / max(1, total) >= RELATED_SHARE:
                out |= {h, *section}
        return out


def email_addresses(text: str) -> list[str]:
    """Runs of EMAIL_NAME and EMAIL_HOST, looked for from each @ back, so that long runs without one cost nothing."""
    out, at = [], 0
    for m in EMAIL_HOST.finditer(text):
        start = m.start()
        while start > at and EMAIL_NAME.fullmatch("a" + text[start - 1]):
            start -= 1
        name = EMAIL_NAME.search(text, start, m.start())
        if name and name.end() == m.start():
            out.append(text[name.start() : m.end()])
        at = m.end()
    return out


def web_url(value: str, base: str) -> str | None:
    """A link as a full http or https url; null for others, and for those with a user's name."""
    try:
        u = urlsplit(urljoin(base, re.sub(r"[\t\n\r]", "", value.strip())))
        if not value.strip() or u.scheme not in ("http", "https") or not u.hostname or "@" in u.netloc:
            return None
        port = u.port
    except ValueError:
        return None
    name = f"[{u.hostname}]" if ":" in u.hostname else u.hostname
    place = name if port in (None, 80 if u.scheme == "http" else 443) else f"{name}:{port}"
    return f"{u.scheme}://{place}{(u.path or '/').replace(' ', '%20')}" + (f"?{u.query}" if u.query else "") + (f"#{u.fragment}" if u.fragment else "")


def origin(url: str | None) -> str | None:
    return None if url is None else "/".join(url.split("/", 3)[:3])


def read_page(url: str, html: str, whole: bool = False) -> dict:
    """The record of a page: see extract_pages."""
    t = Tree(html or "")
    meta = lambda key, value: next((squeeze(t.attrs[i].get("content", "")) for i in t.elements("meta") if t.attrs[i].get(key, "").lower() == value), "")
    title = next((squeeze("".join(t.words[t.first[i] : t.end[i]])) for i in t.elements("title")), "") or meta("property", "og:title")
    canonical = next((t.attrs[i].get("href", "") for i in t.elements("link") if "canonical" in t.attrs[i].get("rel", "").lower().split()), "")
    here = web_url(url or "", "") or ""
    base = next((web_url(t.attrs[i]["href"], here) for i in t.elements("base") if "href" in t.attrs[i]), None)
    base = base if base and origin(base) == origin(here) else here  # a base elsewhere must not lead links away from the source
    regions = t.regions()
    main = {k for r in regions for k in t.within(r)}
    leading = t.related(regions)
    under = {k for n in leading for k in t.within(n)}

    phones: dict[str, None] = {}
    emails: dict[str, None] = {}
    links: dict[str, dict] = {}
    near: dict[int, str] = {}
    cut = False
    anchors = [k for k in t.elements("a", "area") if "href" in t.attrs[k] and not t.hidden[k]]
    for k in sorted(anchors, key=lambda k: k not in main):
        href = t.attrs[k]["href"].strip()
        said = t.text(k, breaks=False) or squeeze(t.attrs[k].get("aria-label") or t.attrs[k].get("title") or next((t.attrs[i]["alt"] for i in t.within(k) if t.tag[i] == "img" and "alt" in t.attrs[i]), ""))
        away = t.menu[k] > 0 or k not in main
        if href.lower().startswith(("tel:", "mailto:")):
            if not away and href[:4].lower() == "tel:":
                phones[href[4:]] = None
            elif not away:
                emails[href[7:].split("?")[0]] = None
            continue
        to = web_url(href, base) if href and not href.startswith("#") else None
        if to is None:
            continue
        old = links.get(to)
        if old is None and not whole and len(links) >= LINK_LIMIT:
            cut = True
        elif old is None or (old["navigation"] and not away) or (not old["text"] and said):
            context = ""
            if not away:
                box = next((i for i in t.above(k) if t.tag[i] in AROUND_LINK), t.up[k])
                around = near.setdefault(box, t.text(box))
                start = max(0, around.find(said) - CONTEXT_BEFORE)
                context = around[start : start + CONTEXT_LIMIT]
            links[to] = {"url": to, "text": said, "navigation": away, "context": context, "related": k in under}

    def body(frames: bool) -> tuple[str, list[str]]:
        """Text and headings of the main region; frames: headers and footers of the page are left out."""
        texts, heads = [], []
        for r in regions:
            out = lambda k, r=r: k in leading or t.menu[k] > t.menu[r] or (frames and t.tag[k] in ("header", "footer") and not t.inner[k])
            texts.append("" if r in leading else t.text(r, out))
            gone = {i for s in t.skipped(r, out) for i in t.within(s)}
            heads += [t.text(k) for k in t.within(r) if t.tag[k] in ("h1", "h2", "h3", "h4") and k not in gone]
        return squeeze(" ".join(texts)), [h for h in heads if h]

    text, headings = body(True)
    if not text:  # a header that never ends
        text, headings = body(False)
    digits = lambda s: re.sub(r"\D", "", s)
    most, heads = (len(text), len(headings)) if whole else (TEXT_LIMIT, HEADING_LIMIT)
    for m in PHONE.finditer(text):
        if not any(digits(p).endswith(digits(m.group())) for p in phones):
            phones[m.group()] = None
    for address in email_addresses(text):
        emails.setdefault(address)
    return {
        "title": title, "description": meta("name", "description") or meta("property", "og:description"), "canonical": web_url(canonical, here), "headings": headings[:heads], "text": text[:most], "excerpt": text[:EXCERPT_LIMIT],
        "links": list(links.values()), "phones": list(phones), "emails": list(emails), "content_hash": hashlib.sha256(f"{title}\n{text}".encode("utf-8", "surrogatepass")).hexdigest(), "text_size": len(text), "anchors": len(anchors),
        "truncated": {"text": len(text) > most, "excerpt": len(text) > EXCERPT_LIMIT, "headings": len(headings) > heads, "links": cut},
    }
