"""Repositories on public code hosts as inventories and file tables.

What a host answers is read by Spark: listings are JSON columns with a fixed schema, pages
and file bodies are fetched by the tasks that hold their rows. Every failure is a null or a
missing row, never an exception. ``get`` (url, headers, body) -> bytes can be replaced.
"""

from __future__ import annotations

import json
import os
import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.durable import durable

Get = Callable[[str, dict, bytes | None], bytes | None]

# Addresses, what a repository's address looks like, page and batch sizes.
HUB_URL = re.compile(r"^https://github\.com/([A-Za-z0-9_.\-]+)/([A-Za-z0-9_.\-]+?)(?:\.git)?$")
LAB_URL = re.compile(r"^https://gitlab\.com/([A-Za-z0-9_.\-/]+?)(?:\.git)?/?$")
GIT_REF = re.compile(r"^[A-Za-z0-9._/\-]{1,250}$")
HUB_API, HUB_RAW, LAB = "https://api.github.com", "https://raw.githubusercontent.com", "https://gitlab.com"
PAGE_SIZE, MAX_PAGES = 100, 100
TOKENS = {"github": "GITHUB_TOKEN", "gitlab": "GITLAB_TOKEN"}
SIZES_QUERY = "query($p: ID!, $paths: [String!]!, $ref: String!) { project(fullPath: $p) { repository { blobs(paths: $paths, ref: $ref) { nodes { path size } } } } }"

_TREE = "struct<truncated:boolean,tree:array<struct<path:string,type:string,size:bigint>>>"
_PAGE = "array<struct<path:string,type:string>>"
_SIZES = "struct<errors:array<string>,data:struct<project:struct<repository:struct<blobs:struct<nodes:array<struct<path:string,size:string>>>>>>>"


@dataclass(frozen=True)
class Repository:
    host: str
    owner: str
    name: str

    @property
    def token(self) -> str | None:
        return os.environ.get(TOKENS[self.host]) or None


def repository(url: str) -> Repository | None:
    """The repository that ``url`` names, None where no known host does."""
    if found := HUB_URL.match(url):
        return Repository("github", found[1], found[2])
    if found := LAB_URL.match(url):
        parts = found[1].split("/")
        if len(parts) >= 2 and all(p and p not in (".", "..") for p in parts):
            return Repository("gitlab", "/".join(parts[:-1]), parts[-1])
    return None


def checked_ref(ref: str) -> str:
    if ref and not GIT_REF.match(ref):
        raise ValueError("a ref is 1 to 250 of A-Z a-z 0-9 . _ / -")
    return ref


def http_get(url: str, headers: dict, body: bytes | None = None) -> bytes | None:
    request = urllib.request.Request(url, data=body, headers={"User-Agent": "lodestone", **headers})
    try:
        with urllib.request.urlopen(request, timeout=60) as answer:
            return answer.read()
    except (urllib.error.URLError, TimeoutError, OSError):
        return None


def headers(repo: Repository, **more: str) -> dict:
    return {**({"Authorization": f"Bearer {repo.token}"} if repo.token else {}), **more}


def _quoted(text: str) -> str:
    return urllib.parse.quote(text, safe="/-._~")


def _project(repo: Repository) -> str:
    return f"{LAB}/api/v4/projects/{urllib.parse.quote(f'{repo.owner}/{repo.name}', safe='')}"


def default_branch(repo: Repository, get: Get = http_get) -> str | None:
    url = f"{HUB_API}/repos/{repo.owner}/{repo.name}" if repo.host == "github" else _project(repo)
    try:
        return json.loads(get(url, headers(repo), None) or b"{}").get("default_branch") or None
    except (ValueError, AttributeError):
        return None


def raw_url(repo: Repository, ref: str, path: str) -> str:
    if repo.host == "github":
        return f"{HUB_RAW}/{repo.owner}/{repo.name}/{ref}/{_quoted(path)}"
    owner = "/".join(urllib.parse.quote(p, safe="") for p in repo.owner.split("/"))
    return f"{LAB}/{owner}/{urllib.parse.quote(repo.name, safe='')}/-/raw/{_quoted(ref)}/{_quoted(path)}"


def tree_entries(answers: DataFrame) -> DataFrame:
    """``path, size`` of the blobs in tree answers (column ``body``); a truncated answer has none."""
    read = answers.select(F.from_json("body", _TREE).alias("a")).where(~F.coalesce("a.truncated", F.lit(False)))
    return read.select(F.explode("a.tree").alias("e")).where("e.type = 'blob'").select("e.path", F.coalesce("e.size", F.lit(0)).alias("size"))


def _fetched(rows: DataFrame, get: Get, request: Callable[[pd.Series], tuple[str, dict, bytes | None]]) -> DataFrame:
    """``rows`` with ``body``, the answer to each row's request, null where it failed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [get(*request(row)) for _, row in frame.iterrows()]
            yield frame.assign(body=[None if a is None else a.decode("utf-8", "replace") for a in answers])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, body string")


def inventory(spark: SparkSession, repo: Repository, ref: str = "", get: Get = http_get) -> DataFrame | None:
    """``path, size`` of all files of a revision; None where the host gives no full listing."""
    ref = checked_ref(ref) or default_branch(repo, get) or ""
    if not ref:
        return None
    if repo.host == "github":
        body = get(f"{HUB_API}/repos/{repo.owner}/{repo.name}/git/trees/{_quoted(ref)}?recursive=1", headers(repo), None)
        try:
            if body is None or json.loads(body).get("truncated"):
                return None
        except (ValueError, AttributeError):
            return None
        return tree_entries(spark.createDataFrame([(body.decode("utf-8", "replace"),)], "body string"))
    plain = headers(repo)
    page_url = f"{_project(repo)}/repository/tree?recursive=true&per_page={PAGE_SIZE}&ref={_quoted(ref)}&page="
    pages, at = None, 1
    # Pages are asked for in waves, the first of one page, until one is not full; a full last page may not be the end.
    for wave in (1, 4, 15, 40, MAX_PAGES):
        numbers = spark.range(at, min(at + wave, MAX_PAGES + 1), numPartitions=min(wave, 16)).withColumnRenamed("id", "page")
        got = durable(_fetched(numbers, get, lambda row: (f"{page_url}{row['page']}", plain, None)).select("page", F.from_json("body", _PAGE).alias("entries")), "pages")
        pages, at = got if pages is None else pages.unionByName(got), at + wave
        state = got.agg(F.count_if(F.col("entries").isNull()).alias("failed"), F.count_if(F.size("entries") < PAGE_SIZE).alias("last")).first()
        if state["failed"]:
            return None
        if state["last"]:
            break
    else:
        return None
    # A page has no more paths than a query takes.
    paths = F.transform(F.filter("entries", lambda e: e["type"] == "blob"), lambda e: e["path"])
    asked = pages.select("page", paths.alias("paths")).where(F.size("paths") > 0)
    post = headers(repo, Accept="application/json", **{"Content-Type": "application/json"})
    full = f"{repo.owner}/{repo.name}"

    def query(row: pd.Series) -> tuple[str, dict, bytes]:
        variables = {"p": full, "paths": list(row["paths"]), "ref": ref}
        return f"{LAB}/api/graphql", post, json.dumps({"query": SIZES_QUERY, "variables": variables}).encode()

    answers = _fetched(asked, get, query).select(F.from_json("body", _SIZES).alias("a")).persist()
    if answers.where("a is null or a.errors is not null").count():
        return None
    nodes = answers.select(F.explode("a.data.project.repository.blobs.nodes").alias("n"))
    return nodes.select("n.path", F.expr("try_cast(n.size AS BIGINT)").alias("size")).where("size is not null")


def fetch(files: DataFrame, repo: Repository, ref: str, get: Get = http_get, tasks: int = 16) -> DataFrame:
    """``path, size, content`` of ``files`` (``path, size``); content is null where the fetch failed."""
    plain = headers(repo)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(content=[get(raw_url(repo, ref, p), plain, None) for p in frame["path"]])

    return files.select("path", "size").repartition(tasks, "path").mapInPandas(run, "path string, size bigint, content binary")
