"""A transport that answers from a small made-up network, for tests of the data source."""

FOLLOWERS = {f"u{i}": [f"u{j}" for j in range(400) if (i * j) % 7 == 1 and i != j] for i in range(12)}
CALLS: list = []


def transport(endpoint, params):
    CALLS.append((endpoint, params))
    at = int(params.get("cursor") or 0)
    more = lambda items: {"cursor": str(at + 100)} if at + 100 < len(items) else {}
    if endpoint == "getFollowers":
        items = FOLLOWERS[params["actor"]]
        return 200, {"followers": [{"handle": h} for h in items[at:at + 100]]} | more(items)
    if endpoint == "getFollows":
        items = [f for f in FOLLOWERS if params["actor"] in FOLLOWERS[f]]
        return 200, {"follows": [{"handle": h} for h in items[at:at + 100]]} | more(items)
    if endpoint == "getProfiles":
        assert len(params["actors"]) <= 25
        return 200, {"profiles": [{"handle": a, "did": f"did:{a}", "followersCount": len(FOLLOWERS.get(a, []))} for a in params["actors"] if a != "u3"]}
    if endpoint == "getRelationships":
        assert len(params["others"]) <= 30
        return 200, {"relationships": [{"did": d, "following": "x" if d.endswith("1") else None} for d in params["others"]]}
    posts = [{"post": {"uri": f"{params['actor']}/{i}", "record": {"text": f"post {i}" if i % 5 else "", "createdAt": "2023-03-01T00:00:00Z"}}} for i in range(250)]
    return 200, {"feed": posts[at:at + 100]} | more(posts)
