"""Pages of a feed, for tests of the data source, whose reader runs in a worker."""


def zen(url, headers):
    page = int(url.rsplit("=", 1)[1]) if "page=" in url and "per_page" not in url else 1
    return 200, {"results": [{"tags": ["a", "b"]}, {"tags": []}, {}], "next_page": f"https://z/search?page={page + 1}"}


def desk(url, headers):
    """250 tickets in pages, one a day and hour; every third changed again on 20 January. A page fails once."""
    import os
    import pathlib
    import re
    import urllib.parse

    since, page = (re.search(rf"[?&]{k}=([^&]*)", url)[1] for k in ("updated_since", "page"))
    once = pathlib.Path(urllib.parse.urlparse(url).path.split("/api")[0]) / f"failed-{since[:10]}-{page}"
    if page == "2" and not once.exists():
        os.close(os.open(once, os.O_CREAT))
        return 503, None
    rows = [{"id": k, "type": f"t{k % 2}", "updated_at": f"2024-01-{1 + k // 24:02d}T{k % 24:02d}:00:00Z"} for k in range(250)]
    rows += [{"id": k, "type": "again", "updated_at": f"2024-01-20T{k % 24:02d}:00:00Z"} for k in range(0, 250, 3)]
    rows = [t for t in rows if t["updated_at"] >= since]
    return 200, rows[(int(page) - 1) * 100 : int(page) * 100]


def gone(url, headers):
    return 500, None
