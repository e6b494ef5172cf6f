"""Facts of HTML pages from one pass of the standard library's streaming parser per page."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import spread

#: Hosts of social platforms whose links are profiles.
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "x.com", "twitter.com", "youtube.com", "tiktok.com")
#: JSON-LD types that describe an organisation.
ORGANISATION_TYPES = ("Organization", "Corporation", "LocalBusiness", "NGO", "Store", "Restaurant", "EducationalOrganization")


class _Facts(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] | None = None
        self.titled = False
        self.meta: dict[str, str] = {}
        self.links: list[str] = []
        self.times: list[str] = []
        self.jsonld: list[str] = []
        self._script: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        have = {k: v or "" for k, v in attrs}
        if tag == "title" and self.title is None:
            self.title = []
        elif tag == "meta":
            name = (have.get("name") or have.get("property") or "").lower()
            if name and name not in self.meta:
                self.meta[name] = have.get("content", "")
        elif tag == "link" and "canonical" in have.get("rel", "").lower().split():
            self.meta.setdefault("canonical", have.get("href", ""))
        elif tag == "a" and "href" in have:
            self.links.append(have["href"])
        elif tag == "time" and have.get("datetime"):
            self.times.append(have["datetime"])
        elif tag == "script" and have.get("type", "").lower() == "application/ld+json":
            self._script = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.titled = True
        elif tag == "script" and self._script is not None:
            self.jsonld.append("".join(self._script))
            self._script = None

    def handle_data(self, data: str) -> None:
        if self._script is not None:
            self._script.append(data)
        elif self.title is not None and not self.titled:
            self.title.append(data)


def organisations_in(documents: list[str]) -> Iterator[tuple[str | None, str | None]]:
    """Name and URL of the organisations anywhere in JSON-LD documents; broken documents have none."""
    stack: list[object] = []
    for text in documents:
        try:
            stack.append(json.loads(text))
        except (ValueError, RecursionError):
            continue
        while stack:
            v = stack.pop()
            if isinstance(v, list):
                stack += reversed(v)
            elif isinstance(v, dict):
                kinds = v.get("@type")
                if any(k in ORGANISATION_TYPES for k in (kinds if isinstance(kinds, list) else [kinds])):
                    text_of = lambda k: v[k] if isinstance(v.get(k), str) else None  # noqa: B023, E731
                    yield text_of("name"), text_of("url")
                stack += [x for x in reversed(v.values()) if isinstance(x, dict | list)]


def _resolved(base: str | None, link: str) -> str | None:
    try:
        url = urljoin(base or "", link.strip())
        return url if urlsplit(url).scheme in ("http", "https") else (None if base else link.strip() or None)
    except ValueError:
        return None


_STRUCT = pa.struct([("name", pa.string()), ("url", pa.string())])


def page_facts(pages: DataFrame, keys: dict[str, Column], html: Column, base: Column | None = None) -> DataFrame:
    """``keys``, ``title``, ``description``, ``canonical``, ``links`` (resolved against ``base`` where given),
    ``times``, ``organisations`` of each page. Null pages give no row; absent facts are null or empty."""
    picked = pages.select(*[c.alias(k) for k, c in keys.items()], html.alias("__html"), (base if base is not None else F.lit(None).cast("string")).alias("__base")).where("__html IS NOT NULL")
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, at in zip(b.column("__html").to_pylist(), b.column("__base").to_pylist(), strict=True):
                p = _Facts()
                p.feed(text)
                p.close()
                links = [u for x in p.links if (u := _resolved(at, x))]
                title = " ".join("".join(p.title or []).split()) or None
                organisations = [{"name": n, "url": u} for n, u in organisations_in(p.jsonld)]
                rows.append((title, p.meta.get("description") or p.meta.get("og:description") or None, p.meta.get("canonical") or None, links, p.times, organisations))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(_STRUCT)]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*names, "title", "description", "canonical", "links", "times", "organisations"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.select(*names).schema)
    return spread(picked).mapInArrow(run, schema + ", title string, description string, canonical string, links array<string>, times array<string>, organisations array<struct<name: string, url: string>>")


def social_links(links: Column, hosts: Sequence[str] = SOCIAL_HOSTS) -> Column:
    """Links of an array that are profiles on social platforms, sorted and distinct."""
    from millrace.functions.urls import host, under_any

    return F.array_sort(F.array_distinct(F.filter(links, lambda u: under_any(host(u), list(hosts)))))
