"""Hand-labelled source templates.

Each template is a small file with the findings we expect, written down by hand. ``comments`` and ``strings``
list the pieces a scrubber has to blank, in order, and ``nodes`` counts the loops, calls and functions of a
Python file. They serve both as corpus text and as expected values.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    ext: str
    content: str
    findings: tuple[str, ...] = ()
    comments: tuple[str, ...] = ()
    strings: tuple[str, ...] = ()
    nodes: tuple[int, int, int] = (0, 0, 0)
    error: bool = False

    def labels(self) -> list[tuple[str, int]]:
        return [(rule, int(line)) for rule, line in (f.split("@") for f in self.findings)]

    def blanked(self, pieces: tuple[str, ...]) -> str:
        text, start = self.content, 0
        for piece in pieces:
            at = text.index(piece, start)
            hidden = "".join(c if c == "\n" else " " for c in piece)
            text, start = text[:at] + hidden + text[at + len(piece):], at + len(piece)
        return text

    @property
    def stripped(self) -> str:
        return self.blanked(self.comments)

    @property
    def masked(self) -> str:
        both = sorted((*self.comments, *self.strings), key=self.content.index)
        return self.blanked(tuple(both))


TEMPLATES: tuple[Template, ...] = (
    Template(".py", "for i in xs:\n    for j in ys:\n        use(i, j)\n", ("GC001@2",), nodes=(2, 1, 0)),
    Template(".py", "import requests\nfor u in us:\n    requests.get(base + u)\n", ("GC020@3", "GC022@3"),
             nodes=(1, 1, 0)),
    Template(".py", "fh = open('x')\nbody = fh.read()\n", ("GC010@2", "GC011@1"), strings=("'x'",), nodes=(0, 2, 0)),
    Template(".py", "with open('x') as fh:\n    for row in fh:\n        out += row + ','\n", ("GC002@3",),
             strings=("'x'", "','"), nodes=(1, 1, 0)),
    Template(".py", "import time\nwhile True:\n    time.sleep(1)\n", ("GC003@2",), nodes=(1, 1, 0)),
    Template(".py", "async def f():\n    time.sleep(1)\n    def g():\n        time.sleep(2)\n", ("GC005@2",),
             nodes=(0, 2, 2)),
    Template(".py", "def fib(n):\n    return fib(n - 1) + fib(n - 2)\n", ("GC009@1",), nodes=(0, 2, 1)),
    Template(".py", "import functools\n@functools.lru_cache\ndef fib(n):\n    return fib(n - 1) + fib(n - 2)\n",
             nodes=(0, 2, 1)),
    Template(".py", "for x in sorted(ys):\n    if x in [1, 2]:\n        re.sub('a', 'b', x)\n",
             ("GC004@3", "GC007@1", "GC008@2"), strings=("'a'", "'b'"), nodes=(1, 2, 0)),
    Template(".py", "total = sum([v for v in vs])\nname = ','.join([t for t in ts])\n", ("GC012@1", "GC012@2"),
             strings=("','",), nodes=(0, 2, 0)),
    Template(".py", "for r in rows:\n    conn.execute(q)\n    cursor.execute(q)\n    copy.deepcopy(r)\n",
             ("GC013@4", "GC021@3"), nodes=(1, 3, 0)),
    Template(".py", "# print('x')\nprint('y')\nlogger.debug(f'v={v}')\nfrom a.b import *\n",
             ("GC040@2", "GC041@3", "GC042@3", "GC050@4"), comments=("# print('x')",), strings=("'y'", "'v={v}'"),
             nodes=(0, 2, 0)),
    Template(".py", "q = \"SELECT * FROM t\"\ncur.execute(\"DELETE FROM logs\")\nDEBUG = True\n",
             ("GC030@1", "GC031@1", "GC032@2", "GC060@3"), strings=("\"SELECT * FROM t\"", "\"DELETE FROM logs\""),
             nodes=(0, 1, 0)),
    Template(".py", "def broken(:\n    print(1)\n", ("GC040@2",), error=True),
    Template(".py", "for i, r in df.iterrows():\n    pass\n", ("GC006@1",), nodes=(1, 1, 0)),
    Template(".js", "for (let i = 0; i < n; i++) {\n  for (let j = 0; j < n; j++) {\n    f(i, j);\n  }\n}\n",
             ("GC001@2",)),
    Template(".js", "g(() => {\n  for (const a of b) {\n    for (const c of a) {\n    }\n  }\n});\n"),
    Template(".js", "fetch('/a');\nfetch('/b', { signal: s });\nsetInterval(() => t(), 16);\n"
                    "console.log('x'); // console.log\n",
             ("GC023@1", "GC040@4", "GC063@3"), comments=("// console.log",), strings=("'/a'", "'/b'", "'x'")),
    Template(".js", "new CoinHive.Anonymous('k');\n/* coinhive.min.js */\nvar s = 'coinhive';\n", ("GC062@1",),
             comments=("/* coinhive.min.js */",), strings=("'k'", "'coinhive'")),
    Template(".go", "for i := 0; i < n; i++ {\n  for j := 0; j < n; j++ {\n  }\n}\n"),
    Template(".go", "for _, a := range xs {\n  for _, b := range ys {\n  }\n}\n", ("GC001@2",)),
    Template(".sql", "SELECT * FROM orders WHERE x = 1;\nSELECT id FROM events;\n-- SELECT * FROM z;\n",
             ("GC030@1", "GC031@2"), comments=("-- SELECT * FROM z;",)),
    Template(".sql", "UPDATE t SET a = 1;\nDELETE FROM t WHERE a = 1;\nSELECT a FROM t WHERE n LIKE '%x';\n",
             ("GC032@1", "GC033@3"), strings=("'%x'",)),
    Template(".html", "<img src=a>\n<img src=b loading=lazy>\n<video autoplay src=c></video>\n"
                      "<p style='animation: s 1s infinite'>\n",
             ("GC061@4", "GC064@3", "GC071@1"), strings=("'animation: s 1s infinite'",)),
    Template(".css", "/* animation: a infinite */\n.b { animation: s 1s linear infinite; }\n",
             ("GC061@1", "GC061@2")),
    Template(".yml", "# restart: always\nrestart: always\nreplicas: 8\nreplicas: 2\ncron: \"* * * * *\"\n",
             ("GC090@5", "GC091@2", "GC093@3"), comments=("# restart: always",), strings=("\"* * * * *\"",)),
    Template(".json", "{\"debug\": true, \"h\": \"Cache-Control: no-store\"}\n", ("GC060@1", "GC092@1"),
             strings=("\"debug\"", "\"h\"", "\"Cache-Control: no-store\"")),
    Template(".toml", "# debug = true\n", ("GC060@1",)),
    Template(".dockerfile", "FROM python:latest\nRUN pip install x\nADD a.py /a\n",
             ("GC080@1", "GC081@1", "GC082@2", "GC083@1", "GC084@3")),
    Template(".dockerfile", "FROM python:3.12-slim AS b\n"
                            "RUN pip install --no-cache-dir x && apt-get install y\nADD a.tar.gz /a\nFROM b\n",
             ("GC080@4", "GC082@2")),
    Template(".md", "SELECT * FROM t;\nprint('x')\n", strings=("'x'",)),
)
