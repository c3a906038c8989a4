"""An offline stand-in for three kinds of zoning services. An endpoint is a path; each request is noted in a file beside it."""

PARCELS = [(f"{i} MAIN ST", f"C-{i % 7}") for i in range(1, 24)] + [("5 MAIN ST", "R-1"), ("90 O'NEIL AV", ""), ("91 O'NEIL AV", "A-1")]


def serve(request):
    params = dict(request.params)
    with open(request.url.split("/__")[0] + ".log", "a", encoding="utf-8") as f:
        f.write(f"{sorted(params.items())}\n")
    if "down" in request.url:
        raise OSError("down")
    rows = PARCELS
    if request.url.endswith("/query"):
        if params["where"] != "1=1":
            asked = params["where"].split(" = ", 1)[1][1:-1].replace("''", "'")
            rows = [r for r in rows if r[0] == asked]
        start, n = int(params.get("resultOffset", 0)), int(params["resultRecordCount"])
        return {"features": [{"attributes": {"addr": a, "zone": z}} for a, z in rows[start : start + n]]}
    if "/api/records" in request.url:
        if "q" in params:
            rows = [r for r in rows if r[0] == params["q"].split(":", 1)[1].strip('"').upper()]
        elif "geofilter.distance" in params:
            rows = rows[int(float(params["geofilter.distance"].split(",")[0])) :][:1]
        start, n = int(params.get("start", 0)), int(params["rows"])
        return {"records": [{"fields": {"addr": a, "zone": z}} for a, z in rows[start : start + n]]}
    if "addr" in params:
        rows = [r for r in rows if r[0] == params["addr"]]
    start, n = int(params.get("$offset", 0)), int(params["$limit"])
    return [{"addr": a, "zone": z} for a, z in rows[start : start + n]]
