"""Small sequential models of both change-log profiles, for comparison only, and a
generator of file-system histories that are consistent with themselves."""

from __future__ import annotations

import posixpath
import random

NULL_FID = "0:0x0:0x0"


def reduce_slots(batch, profile, rules):
    """Events of one batch in slot order after the rules."""
    slots = {}
    for ev in batch:
        if profile == "inotify":
            key, barrier = str(ev["inode"]), None
        else:
            barrier = "08RENME"
            key = ev["source_fid"] if ev["event_type"] == barrier else ev["target_fid"]
        kept = slots.setdefault(key, [])
        action, targets = rules.get(ev["event_type"], (None, ()))
        if action == "ignore" and any(k["event_type"] in targets for k in kept):
            continue
        if action == "cancel":
            hits = [i for i, k in enumerate(kept) if k["event_type"] in targets or k["event_type"] == barrier]
            if hits and kept[hits[-1]]["event_type"] in targets:
                del kept[hits[-1]]
                continue
        kept.append(ev)
    return [e for kept in slots.values() for e in kept]


class Model:
    def __init__(self, profile, resolver=None):
        self.profile, self.resolver = profile, resolver or {}
        self.nodes, self.kids, self.told = {}, {}, set()
        self.touched, self.gone = set(), []
        self.claim = {}

    def owner(self, path):
        """Last object that took the path, when it still has it."""
        fid = self.claim.get(path)
        return fid if fid in self.nodes and self.nodes[fid]["path"] == path else None

    def remove(self, fid, parent):
        node = self.nodes.get(fid)
        if node is None:
            return
        self.gone.append((fid, node["path"] or "FileRemoved"))
        if self.profile == "inotify":
            parent = node["parent"]
            if parent in self.kids:
                self.touched.add(parent)
        elif parent in self.nodes and self.nodes[parent]["path"]:
            self.touched.add(parent)
        if parent in self.kids:
            self.kids[parent].discard(fid)
        if node["is_dir"]:
            self.kids.pop(fid, None)
        del self.nodes[fid]

    def move_below(self, top):
        for kid in sorted(self.kids.get(top, ())):
            node = self.nodes.get(kid)
            if node is None:
                continue
            base = self.nodes[top]["path"]
            node["path"] = posixpath.join(base, node["name"]) if base else None
            self.claim[node["path"]] = kid
            self.touched.add(kid)
            if node["is_dir"]:
                self.move_below(kid)

    def apply(self, ev, tick):
        if self.profile == "inotify":
            self.apply_inotify(ev, tick)
        else:
            self.apply_fid(ev, tick)

    def apply_inotify(self, ev, tick):
        kind, fid, path = ev["event_type"], str(ev["inode"]), ev["path"]
        stat = {c: ev[c] for c in ("size", "atime", "ctime", "mtime")}
        node = self.nodes.get(fid)
        if kind == "IN_CREATE":
            parent = self.owner(posixpath.dirname(path))
            self.nodes[fid] = dict(
                parent=parent, name=posixpath.basename(path), path=path, is_dir=ev["is_dir"],
                stat=stat, owner={c: ev[c] for c in ("permissions", "uid", "gid")},
            )
            self.claim[path] = fid
            if ev["is_dir"]:
                self.kids.setdefault(fid, set())
            if parent:
                self.kids.setdefault(parent, set()).add(fid)
            self.touched.add(fid)
        elif node is None or kind in ("IN_MOVED_FROM", "IN_DELETE_SELF", "IN_MOVE_SELF"):
            return
        elif kind == "IN_DELETE":
            self.remove(fid, None)
        elif kind == "IN_MOVED_TO":
            other = self.owner(path)
            if other and other != fid:
                self.remove(other, None)
            self.kids.get(node["parent"], set()).discard(fid)
            parent = self.owner(posixpath.dirname(path))
            if parent:
                self.kids.setdefault(parent, set()).add(fid)
            node.update(parent=parent, name=posixpath.basename(path), path=path, stat=stat)
            self.claim[path] = fid
            self.touched.add(fid)
            if node["is_dir"]:
                self.move_below(fid)
        else:
            node["stat"] = stat
            self.touched.add(fid)

    def apply_fid(self, ev, tick):
        kind, fid, up = ev["event_type"], ev["target_fid"], ev["parent_fid"]
        if kind in ("01CREAT", "02MKDIR"):
            parent = self.nodes.get(up)
            if parent is None or not parent["path"]:
                if up not in self.resolver:
                    return
                path = self.resolver[up]
                parent = dict(parent=None, name=posixpath.basename(path), path=path, is_dir=True)
                self.nodes[up], self.kids[up] = parent, set()
            self.touched |= {up, fid}
            self.nodes[fid] = dict(
                parent=up, name=ev["name"], path=posixpath.join(parent["path"], ev["name"]),
                is_dir=kind == "02MKDIR",
            )
            if kind == "02MKDIR":
                self.kids[fid] = set()
            self.kids[up].add(fid)
        elif kind in ("06UNLNK", "07RMDIR"):
            self.remove(fid, up)
        elif kind == "08RENME":
            if fid != NULL_FID:
                self.remove(fid, up)
            src, old = ev["source_fid"], ev["source_parent_fid"]
            for p in (old, up):
                if p in self.nodes:
                    self.touched.add(p)
            self.kids.get(old, set()).discard(src)
            if up in self.nodes and up in self.kids:
                self.kids[up].add(src)
            node = self.nodes.get(src)
            if node is None or not node["path"]:
                return
            base = self.nodes.get(up, {}).get("path")
            node.update(parent=up, name=ev["name"], path=posixpath.join(base, ev["name"]) if base else None)
            if node["path"]:
                self.touched.add(src)
            if node["is_dir"]:
                self.move_below(src)
        elif kind in ("13TRUNC", "14SATTR", "17MTIME", "18CTIME", "19ATIME") and fid in self.nodes:
            self.touched.add(fid)

    def flush(self):
        out, dead = [], {f for f, _ in self.gone}
        for fid in self.touched - dead:
            node = self.nodes.get(fid)
            if node and node["path"]:
                extra = {}
                if self.profile == "inotify":
                    extra = {**node["stat"], **node["owner"]}
                out.append(("update", fid, node["path"], extra))
                self.told.add(fid)
        for fid, path in self.gone:
            if fid in self.told:
                self.told.discard(fid)
                out.append(("delete", fid, path, {}))
        self.touched, self.gone = set(), []
        return out


def replay(events, profile, rules, resolver=None, flush_every=1, batches=None):
    """Change rows (flush, op, fid, path, extra) of a whole history."""
    model, out, tick = Model(profile, resolver), [], 0
    numbers = sorted({e["batch_id"] for e in events}) if batches is None else batches
    for b in range(max(numbers, default=-1) + 1):
        for ev in reduce_slots([e for e in events if e["batch_id"] == b], profile, rules):
            tick += 1
            model.apply(ev, tick)
        if (b + 1) % flush_every == 0 or b == max(numbers):
            out += [(b // flush_every, *c) for c in model.flush()]
    return out


def history(seed, steps, profile, batch=20):
    """Events of random but valid operations on a small tree."""
    rng = random.Random(seed)
    tree = {"1": dict(parent=None, name="base", is_dir=True)}
    counter, events, born = [1], [], {}

    def path(fid):
        n = tree[fid]
        return "/base" if n["parent"] is None else path(n["parent"]) + "/" + n["name"]

    def below(fid, top):
        while fid is not None:
            if fid == top:
                return True
            fid = tree[fid]["parent"]
        return False

    def emit(kind, fid, **extra):
        eid = len(events)
        events.append(dict(eid=eid, batch_id=eid // batch, kind=kind, fid=fid, **extra))

    def dirs():
        return [f for f, n in tree.items() if n["is_dir"]]

    def free_name(parent):
        used = {n["name"] for n in tree.values() if n["parent"] == parent}
        return rng.choice([x for x in "abcdefghijklmnopqrstuvwxyz" if x not in used] or ["zz%d" % counter[0]])

    for _ in range(steps):
        roll = rng.random()
        others = [f for f in tree if f != "1"]
        if roll < 0.35 or not others:
            counter[0] += 1
            fid, parent = str(counter[0]), rng.choice(dirs())
            is_dir = rng.random() < 0.35
            name = free_name(parent)
            tree[fid] = dict(parent=parent, name=name, is_dir=is_dir)
            born[fid] = len(events) // batch
            emit("create", fid, parent=parent, name=name, is_dir=is_dir, path=path(fid))
        elif roll < 0.55:
            fid = rng.choice(others)
            emit("update", fid, path=path(fid), is_dir=tree[fid]["is_dir"])
        elif roll < 0.75:
            fid = rng.choice(others)
            # a new directory may come later in slot order than the object moved into it
            settled = [d for d in dirs() if born.get(d, -1) < len(events) // batch or profile == "inotify"]
            parent = rng.choice([d for d in settled if not below(d, fid)])
            old = tree[fid]["parent"]
            # now and then onto an existing file
            files = [f for f, n in tree.items() if n["parent"] == parent and not n["is_dir"] and f != fid]
            over = rng.choice(files) if files and rng.random() < 0.4 and not tree[fid]["is_dir"] else None
            name = tree[over]["name"] if over else free_name(parent)
            if over:
                del tree[over]
            tree[fid].update(parent=parent, name=name)
            emit("rename", fid, parent=parent, name=name, old=old, over=over, path=path(fid), is_dir=tree[fid]["is_dir"])
        else:
            leaves = [f for f in others if not any(n["parent"] == f for n in tree.values())]
            fid = rng.choice(leaves)
            p, n = path(fid), tree.pop(fid)
            emit("delete", fid, parent=n["parent"], name=n["name"], path=p, is_dir=n["is_dir"])

    if profile == "inotify":
        names = {"create": "IN_CREATE", "delete": "IN_DELETE", "rename": "IN_MOVED_TO"}
        return [
            dict(
                eid=e["eid"], batch_id=e["batch_id"], inode=int(e["fid"]), is_dir=e["is_dir"],
                event_type=names.get(e["kind"]) or rng.choice(["IN_MODIFY", "IN_ATTRIB", "IN_OPEN"]),
                path=e["path"], size=e["eid"] * 7 % 101, atime=e["eid"], ctime=e["eid"] + 1, mtime=e["eid"] + 2,
                permissions="p%d" % (e["eid"] % 3), uid=e["eid"] % 5, gid=0,
            )
            for e in events
        ]
    out = []
    for e in events:
        kind = e["kind"]
        code = {
            "create": "02MKDIR" if e["is_dir"] else "01CREAT",
            "delete": "07RMDIR" if e["is_dir"] else "06UNLNK",
            "rename": "08RENME",
        }.get(kind) or rng.choice(["13TRUNC", "14SATTR", "17MTIME", "11CLOSE"])
        moved = kind == "rename"
        out.append(
            dict(
                eid=e["eid"], batch_id=e["batch_id"], event_type=code,
                target_fid=(e["over"] or NULL_FID) if moved else e["fid"],
                uid="0", gid="0", parent_fid=e.get("parent"), name=e.get("name"),
                source_fid=e["fid"] if moved else None, source_parent_fid=e.get("old"),
            )
        )
    return out
