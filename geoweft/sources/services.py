"""Web services and remote files, fetched by Spark tasks into a landing folder and read from
there. Every function takes the fetcher as an argument: `fetch(url, headers, timeout)` gives
(status, body, response headers)."""
from __future__ import annotations

import hashlib
import json
import os
import re
import time
from dataclasses import replace
from urllib.parse import parse_qsl, urlencode, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import stored


def http_get(url: str, headers: dict, timeout: float):
    import requests

    r = requests.get(url, headers=headers, timeout=timeout)
    return r.status_code, r.content, dict(r.headers)


def as_text(body: bytes | str | None) -> str | None:
    return body.decode("utf-8", "replace") if isinstance(body, bytes) else body


def file_system(path: str):
    """The file system a path is on, and the path in it; also usable in tasks."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if ":/" in path:
        return FileSystem.from_uri(path.replace("file:/", "file:///", 1) if re.match("file:/[^/]", path) else path)
    return LocalFileSystem(), path


def exists(path: str) -> bool:
    fs, inside = file_system(path)
    return fs.get_file_info(inside).type.name != "NotFound"


# ---- fixed values: what a WFS request asks for ----
WFS_ASKS = {"SERVICE": "WFS", "VERSION": "2.0.0", "REQUEST": "GetFeature"}
# Further keys that the request decides itself: older spellings, and those of pages and formats.
WFS_DECIDES = ("TYPENAME", "OUTPUTFORMAT", "COUNT", "STARTINDEX")
# ---------------------------------------------------


def wfs_url(src) -> str:
    """One GetFeature request for a layer, in the source's CRS where it names one. Further
    keys of the address are passed on."""
    address, _, given = re.sub("^wfs:", "", src.uri, flags=re.I).partition("?")
    asks = WFS_ASKS | {"TYPENAMES": src.layer or "", "SRSNAME": None}
    if src.crs:
        asks["SRSNAME"] = "urn:ogc:def:crs:{}::{}".format(*src.crs.upper().split(":", 1))
    passed = {key: value for key, value in parse_qsl(given) if key.upper() not in (*asks, *WFS_DECIDES)}
    return f"{address}?{urlencode(passed | {key: value for key, value in asks.items() if value is not None})}"


def arcgis_url(src, offset: int | None = None) -> str:
    """A page of an ArcGIS layer, or (without offset) the request for its row count."""
    root = src.uri.rstrip("/")
    query = {"where": src.where, "outFields": "*", "f": "geojson", "outSR": 4326, "resultOffset": offset,
             "resultRecordCount": src.page_size, "returnGeometry": "true"}
    if offset is None:
        query = {"where": src.where, "returnCountOnly": "true", "f": "json"}
    return f"{root}/{src.layer}/query?{urlencode(query)}" if src.layer else f"{root}/query?{urlencode(query)}"


def oapif_url(src, bbox=None) -> str:
    query = {"limit": src.page_size, **({"bbox": ",".join(str(v) for v in bbox)} if bbox else {})}
    return f"{src.uri.rstrip('/')}/collections/{src.layer}/items?{urlencode(query)}"


def _pages(fetch, url: str, follow: bool):
    """The features of a page, and of those its `next` links lead to."""
    while url:
        status, body, _ = fetch(url, {"Accept": "application/json"}, 120)
        if not 200 <= status < 300:
            raise OSError(f"{url}: HTTP {status}")
        page = json.loads(as_text(body))
        yield from page.get("features", [])
        url = next((ln["href"] for ln in page.get("links", []) if ln.get("rel") == "next"), None) if follow else None


def read_features(spark: SparkSession, src, landing: str | None, fetch=None, tiles: list | None = None) -> DataFrame:
    """ArcGIS pages are fetched side by side (the row count says how many there are); an OGC
    API chain of pages is followed by one task per bounding box in `tiles`."""
    from . import read_geojson

    fetch = fetch or http_get
    if src.format == "arcgis_rest":
        count = json.loads(as_text(fetch(arcgis_url(src), {}, 120)[1]))["count"]
        urls, follow = [arcgis_url(src, at) for at in range(0, max(count, 1), src.page_size)], False
    else:
        urls, follow = [oapif_url(src, b) for b in (tiles or [None])], True

    def pull(batches):
        for batch in batches:
            for url in batch["url"]:
                yield pd.DataFrame({"value": [json.dumps(f) for f in _pages(fetch, url, follow)]})

    todo = spark.createDataFrame([(u,) for u in urls], "url string").repartition(len(urls))
    folder = f"{landing_folder(spark, landing)}/{src.id}-{hashlib.sha256((src.uri + str(src.layer)).encode()).hexdigest()[:12]}-{time.time_ns()}"
    todo.mapInPandas(pull, "value string").write.text(folder)
    return read_geojson(spark, replace(src, lines=True), folder)


def landing_folder(spark: SparkSession, landing: str | None) -> str:
    if landing:
        return landing
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        raise ValueError("fetched files need a shared folder: give `landing`, or set spark.checkpoint.dir")
    return f"{folder.rstrip('/')}/geoweft-landing"


def land(spark: SparkSession, urls: list[str], folder: str, fetch=None, max_age: float | None = None, keep_older: bool = True) -> dict[str, str]:
    """Download each distinct URL once, in parallel; {url: path}. A copy younger than
    `max_age` seconds is used as it is, and an older one when the download fails."""
    fetch = fetch or http_get
    known = f"{folder}/landing"
    fs, inside = file_system(folder)
    fs.create_dir(inside, recursive=True)
    table = "url string, path string, fetched_at double"
    earlier = {}
    if exists(known):
        rows = spark.read.schema(table).json(known).groupBy("url").agg(F.max_by(F.struct("path", "fetched_at"), "fetched_at").alias("r")).filter(F.col("url").isin(list(urls)))
        earlier = {r.url: r.r for r in rows.collect()}
    now = time.time()
    fresh = {u: r.path for u, r in earlier.items() if max_age is not None and now - r.fetched_at <= max_age}
    missing = sorted(set(urls) - set(fresh))
    if not missing:
        return fresh

    def pull(batches):
        for batch in batches:
            out = []
            for url in batch["url"]:
                ending = os.path.splitext(urlparse(url).path)[1]
                path = f"{folder}/{hashlib.sha256(url.encode()).hexdigest()[:24]}-{time.time_ns()}{ending}"
                try:
                    status, body, _ = fetch(url, {}, 300)
                except OSError:
                    status, body = 0, b""
                if 200 <= status < 300:
                    to, name = file_system(path)
                    with to.open_output_stream(name) as f:
                        f.write(body.encode() if isinstance(body, str) else body)
                    out.append((url, path, time.time()))
                else:
                    out.append((url, None, time.time()))
            yield pd.DataFrame(out, columns=["url", "path", "fetched_at"])

    got = stored(spark.createDataFrame([(u,) for u in missing], "url string").repartition(len(missing)).mapInPandas(pull, table))
    got.filter("path IS NOT NULL").write.mode("append").json(known)
    result = dict(fresh)
    for r in got.collect():
        path = r.path or (earlier[r.url].path if keep_older and r.url in earlier else None)
        if path is None:
            raise OSError(f"{r.url} couldn't be downloaded, and there is no earlier copy")
        result[r.url] = path
    return result


def landed_file(spark: SparkSession, src, landing: str | None, fetch=None, max_age: float | None = None) -> str:
    url = wfs_url(src) if src.format == "wfs" else src.uri
    return land(spark, [url], landing_folder(spark, landing), fetch, max_age)[url]
