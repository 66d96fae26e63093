import json
import os
import re

import pytest

from lodestone.sources import hosted


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://github.com/a/b", ("github", "a", "b")), ("https://github.com/a/b.git", ("github", "a", "b")), ("https://github.com/a/b/c", None),
        ("http://github.com/a/b", None), ("https://gitlab.com/g/s/r", ("gitlab", "g/s", "r")), ("https://gitlab.com/g/r.git", ("gitlab", "g", "r")),
        ("https://gitlab.com/r", None), ("https://gitlab.com/g/../r", None), ("https://example.com/a/b", None),
    ],
)
def test_addresses(url, want):
    found = hosted.repository(url)
    assert (found and (found.host, found.owner, found.name)) == want


def test_refs_and_raw_addresses():
    assert hosted.checked_ref("v1/x") == "v1/x"
    with pytest.raises(ValueError):
        hosted.checked_ref("a b")
    assert hosted.raw_url(hosted.Repository("github", "o", "r"), "main", "a b/c.py") == "https://raw.githubusercontent.com/o/r/main/a%20b/c.py"
    assert hosted.raw_url(hosted.Repository("gitlab", "g/s", "r"), "x/y", "d/é") == "https://gitlab.com/g/s/r/-/raw/x/y/d/%C3%A9"


def hub(url, headers, body):
    if "/git/trees/" in url:
        return json.dumps({"truncated": "cut" in url, "tree": [{"path": "a.py", "type": "blob", "size": 5}, {"path": "d", "type": "tree"}, {"path": "e", "type": "blob"}]}).encode()
    if url.startswith("https://api."):
        return b'{"default_branch": "trunk"}' if "/repos/o/r" in url else None
    return b"body" if url.endswith("a.py") else None


def lab(url, headers, body):
    if body is not None:
        asked = json.loads(body)["variables"]["paths"]
        return json.dumps({"data": {"project": {"repository": {"blobs": {"nodes": [{"path": p, "size": str(len(p))} for p in asked]}}}}}).encode()
    page = int(re.search(r"page=(\d+)$", url)[1]) if "page=" in url else 0
    if page:
        assert page <= 100
        known = [{"path": "dir", "type": "tree"}] + [{"path": f"f{i}", "type": "blob"} for i in range(10_000 if "all" in url else 250)]
        return json.dumps(known[(page - 1) * 100 : page * 100]).encode()
    return b'{"default_branch": "main"}'


def test_inventories_and_fetch(spark):
    repo = hosted.Repository("github", "o", "r")
    listing = hosted.inventory(spark, repo, get=hub)
    assert {(r["path"], r["size"]) for r in listing.collect()} == {("a.py", 5), ("e", 0)}
    assert hosted.inventory(spark, repo, "cut", get=hub) is None
    assert hosted.inventory(spark, hosted.Repository("github", "x", "y"), get=hub) is None
    got = {r["path"]: r["content"] for r in hosted.fetch(listing, repo, "trunk", get=hub, tasks=2).collect()}
    assert bytes(got["a.py"]) == b"body" and got["e"] is None
    sizes = {r["path"]: r["size"] for r in hosted.inventory(spark, hosted.Repository("gitlab", "g/s", "r"), get=lab).collect()}
    assert sizes == {f"f{i}": len(f"f{i}") for i in range(250)}
    assert hosted.inventory(spark, hosted.Repository("gitlab", "g", "r"), "main", get=lambda *a: None) is None
    assert hosted.inventory(spark, hosted.Repository("gitlab", "g", "r"), "all", get=lab) is None


@pytest.mark.skipif("TEST_NETWORK" not in os.environ, reason="needs a network")
def test_a_real_answer():
    assert hosted.default_branch(hosted.Repository("github", "apache", "spark"))
