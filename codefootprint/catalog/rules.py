"""The rule catalogue: what is looked for, how severe it is, and where it applies.

A catalogue is an ordinary Python list on the driver (a few dozen rows). Plans are built from it, so a
disabled rule never reaches the plan and a custom rule is just one more element of the list.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

# Language groups, severity weights and line patterns define which rows are findings.
C_LIKE = (
    "javascript", "typescript", "java", "c", "cpp", "csharp", "go", "rust", "kotlin", "swift", "scala", "php",
)
CODE_LANGUAGES = C_LIKE + ("python", "ruby", "sql", "css", "html", "dockerfile")
QUERY_LANGUAGES = (
    "sql", "python", "javascript", "typescript", "java", "php", "ruby", "go", "csharp", "c", "cpp", "kotlin",
    "scala", "rust",
)
PY, JS = ("python",), ("javascript", "typescript")

# Per piece between semicolons: a head whose table has the last keyword's name, else the first head behind that keyword.
_KEYWORD = r"\b(?:where|limit)\b"
_KEYWORD_HEAD = r"\b(?:update\s++(?:where|limit)\s++set|delete\s++from\s++(?:where|limit))\b"
_HEAD = r"\b(?:update\s++\w++\s++set|delete\s++from\s++\w++)\b"
# Looked up before the group takes the text, as a group keeps what it took in an alternative that failed.
_OPEN_STATEMENT = (
    rf"(?=(?:\A|;)(?>[^;]*{_KEYWORD_HEAD})(?![^;]*{_KEYWORD}))((?:\A|;)[^;]*){_KEYWORD_HEAD}"
    rf"|(?>((?:\A|;)(?>[^;]*{_KEYWORD})?+[^;]*?){_HEAD})"
)


@dataclass(frozen=True)
class Rule:
    """One anti-pattern.

    ``languages`` empty means every known language. ``hints`` are substrings of which every matching line
    holds at least one (lower case when ``ignore_case``); a file without any of them is not searched. They
    only save work: leave them empty and the result is the same. ``linear`` is a form of ``pattern`` with the same hits
    for lines of any length: from one start per statement it looks ahead once, where the plain pattern does so from every
    start. Its groups take the text before the start.
    """

    id: str
    name: str
    category: str
    severity: int
    detector: str = "regex"
    languages: tuple[str, ...] = ()
    pattern: str | None = None
    require_absent: str | None = None
    ignore_case: bool = False
    linear: str | None = None
    hints: tuple[str, ...] = ()
    description: str = ""
    remediation: str = ""


DEFAULT_RULES: tuple[Rule, ...] = (
    # compute
    Rule("GC001", "Nested loops", "compute", 3, "nested_loops",
         description="A loop inside a loop does quadratic work or worse, so CPU time outgrows the data.",
         remediation="Index one side in a dict or set, join, or vectorise."),
    Rule("GC002", "String built with += in a loop", "compute", 2, "python_ast", PY,
         description="Each += copies the whole string built so far.",
         remediation="Collect the parts in a list and join them once."),
    Rule("GC003", "Polling loop with sleep", "compute", 4, "python_ast", PY,
         description="An endless loop that sleeps keeps waking the CPU to find nothing to do.",
         remediation="Block on a queue, condition or event instead."),
    Rule("GC004", "Regular expression built in a loop", "compute", 2, "python_ast", PY,
         description="Module level re functions look the pattern up or compile it on every pass.",
         remediation="Compile the pattern once before the loop."),
    Rule("GC005", "Blocking sleep in a coroutine", "compute", 3, "python_ast", PY,
         description="time.sleep stops the event loop and with it every other coroutine.",
         remediation="Await asyncio.sleep."),
    Rule("GC006", "DataFrame walked with iterrows", "compute", 2, languages=PY,
         pattern=r"\.iterrows\s*\(", hints=(".iterrows",),
         description="iterrows makes a Python object per row and is far slower than column operations.",
         remediation="Use column operations, or itertuples where a loop is unavoidable."),
    Rule("GC007", "Sorting in a loop", "compute", 2, "python_ast", PY,
         description="The data is sorted again on every pass.",
         remediation="Sort once outside the loop."),
    Rule("GC008", "Membership test on a literal list in a loop", "compute", 1, "python_ast", PY,
         description="Each test scans the list or tuple.",
         remediation="Test against a set defined before the loop."),
    Rule("GC009", "Branching recursion without a cache", "compute", 2, "python_ast", PY,
         description="A function that calls itself several times solves the same subproblem again and again.",
         remediation="Cache the results or rewrite it as an iteration."),
    # memory
    Rule("GC010", "Whole file read into memory", "memory", 2,
         languages=("python", "javascript", "typescript", "php", "ruby"),
         pattern=r"\.readlines\(|\.read\(\s*\)|readFileSync\(|file_get_contents\(",
         hints=(".readlines(", ".read(", "readFileSync(", "file_get_contents("),
         description="Memory use grows with the size of the file.",
         remediation="Stream the file by line or by block."),
    Rule("GC011", "File opened outside a with block", "memory", 3, "python_ast", PY,
         description="The descriptor may stay open after an error.",
         remediation="Open the file in a with statement."),
    Rule("GC012", "List built only to be reduced", "memory", 2, "python_ast", PY,
         description="A list comprehension passed to a reducer is held in memory for nothing.",
         remediation="Pass a generator expression."),
    Rule("GC013", "Deep copy in a loop", "memory", 2, "python_ast", PY,
         description="Every pass allocates a full copy of the object graph.",
         remediation="Copy once outside the loop or make a shallow copy."),
    # network
    Rule("GC020", "Network call in a loop", "network", 4, "python_ast", PY,
         description="One request per element multiplies latency and traffic.",
         remediation="Use a bulk endpoint or cache the answers."),
    Rule("GC021", "Database query in a loop", "network", 4, "python_ast", PY,
         description="One query per element loads the database N+1 times.",
         remediation="Fetch the rows in one query or join."),
    Rule("GC022", "Request without timeout (Python)", "network", 2, languages=PY,
         pattern=r"\brequests\.(get|post|put|delete|patch|head)\s*\(", require_absent=r"timeout",
         hints=("requests.",),
         description="A slow server can hold the thread for ever.",
         remediation="Pass a timeout."),
    Rule("GC023", "Request without timeout or abort (JavaScript)", "network", 2, languages=JS,
         pattern=r"\b(fetch|axios\.(get|post|put|delete|patch|request))\s*\(",
         require_absent=r"(timeout|signal|AbortController)", hints=("fetch", "axios."),
         description="A slow server can hold the connection for ever.",
         remediation="Pass a timeout or an abort signal."),
    # data
    Rule("GC030", "SELECT *", "data", 2, languages=QUERY_LANGUAGES,
         pattern=r"select\s+\*\s+from", ignore_case=True, hints=("select",),
         description="Columns nobody needs are read and sent.",
         remediation="Name the columns."),
    Rule("GC031", "Query without WHERE or LIMIT", "data", 2, languages=QUERY_LANGUAGES,
         pattern=r"select\s+.+\s+from\s+\w+\s*(;|\"|')", ignore_case=True, hints=("select",),
         linear=r"\A(?>(.*?)select\s).+\sfrom\s++\w++\s*+[;\"']",
         description="The whole table is read.",
         remediation="Filter or limit the query."),
    Rule("GC032", "UPDATE or DELETE without WHERE", "data", 4, languages=QUERY_LANGUAGES,
         pattern=r"\b(update\s+\w+\s+set|delete\s+from\s+\w+)\b(?![^;\n]*(\bwhere\b|\blimit\b))",
         ignore_case=True, hints=("update", "delete"), linear=_OPEN_STATEMENT,
         description="The whole table is rewritten.",
         remediation="Restrict the statement to the rows meant."),
    Rule("GC033", "LIKE with a leading wildcard", "data", 2, languages=QUERY_LANGUAGES,
         pattern=r"like\s+['\"]%", ignore_case=True, hints=("like",),
         description="An index cannot serve the search, so the table is scanned.",
         remediation="Anchor the pattern or use a text index."),
    # observability
    Rule("GC040", "Debug print left in", "observability", 1, languages=PY + JS,
         pattern=r"^\s*print\s*\(|console\.(log|debug|info)\s*\(", hints=("print", "console."),
         description="Debug output costs I/O and storage in production.",
         remediation="Use a logger with a level."),
    Rule("GC041", "Debug level logging", "observability", 1,
         pattern=r"\b(logging|logger|log)\.debug\s*\(", hints=(".debug",),
         description="Verbose logs cost I/O and storage.",
         remediation="Keep debug logging out of production."),
    Rule("GC042", "Log message formatted eagerly", "observability", 1, languages=PY,
         pattern=r"\b(logging|logger|log)\.(debug|info|warning|error|critical|exception)\s*\(\s*f[\"']",
         hints=("log",),
         description="The f-string is built even when the level is off.",
         remediation="Pass the values as logger arguments."),
    # dependencies
    Rule("GC050", "Wildcard import", "dependencies", 1, languages=PY,
         pattern=r"^\s*from\s+[\w\.]+\s+import\s+\*", hints=("import",),
         description="Names nobody uses are loaded.",
         remediation="Import the names in use."),
    Rule("GC051", "Heavy dependency", "dependencies", 2, "dependency",
         description="The package is large to ship, load and keep in memory.",
         remediation="Check whether a lighter package or the standard library will do."),
    Rule("GC052", "Dependency without a pinned version", "dependencies", 1, "dependency",
         description="Builds are not repeatable and download again without need.",
         remediation="Pin a version or a range and keep a lock file."),
    # energy
    Rule("GC060", "Debug mode on", "energy", 3,
         languages=("python", "javascript", "typescript", "json", "yaml", "ini", "toml"),
         pattern=r"DEBUG\s*=\s*True|debug\s*=\s*True|[\"']debug[\"']\s*:\s*true", ignore_case=True,
         hints=("debug",),
         description="Debug mode turns optimisations off and logging up.",
         remediation="Switch it by configuration and keep it off in production."),
    Rule("GC061", "Endless CSS animation", "energy", 2, languages=("css", "html"),
         pattern=r"animation(-iteration-count)?\s*:[^;]*\binfinite\b", ignore_case=True, hints=("infinite",),
         linear=r"(?>((?:\A|;)[^;]*?)animation(?:-iteration-count)?\s*+:)[^;]*\binfinite\b",
         description="The renderer never rests.",
         remediation="Bound the number of iterations and honour reduced motion."),
    Rule("GC062", "Cryptomining script", "energy", 5,
         pattern=r"(coinhive|coin-hive|cryptonight|webminepool|coinimp|deepminer)\s*[./]", ignore_case=True,
         hints=("coinhive", "coin-hive", "cryptonight", "webminepool", "coinimp", "deepminer"),
         description="The visitor's CPU runs at full load for someone else.",
         remediation="Remove the script and look into how it got there."),
    Rule("GC063", "Timer shorter than 100 ms", "energy", 2, languages=("javascript", "typescript", "html"),
         pattern=r"setInterval\s*\([^,]+,\s*([0-9]{1,2})\s*\)", hints=("setInterval",),
         description="The CPU cannot go idle between ticks.",
         remediation="Use a longer interval, animation frames or events."),
    Rule("GC064", "Media that plays by itself", "energy", 2, languages=("html",),
         pattern=r"<(video|audio)[^>]*\bautoplay\b", ignore_case=True, hints=("autoplay",),
         description="Decoding and download start without a user.",
         remediation="Start playback on demand."),
    # assets
    Rule("GC070", "Large binary asset", "assets", 2, "asset",
         description="Large images and media cost bandwidth on every visit.",
         remediation="Compress, resize or use a modern format."),
    Rule("GC071", "Image loaded eagerly", "assets", 1, languages=("html",),
         pattern=r"<img\b(?![^>]*\bloading\s*=)[^>]*>", ignore_case=True, hints=("<img",),
         description="Images off screen are downloaded too.",
         remediation="Add loading=\"lazy\"."),
    Rule("GC072", "Large bundle not minified", "assets", 2, "asset",
         description="Scripts and style sheets are larger than they need to be.",
         remediation="Minify, compress and split the bundle."),
    # infra
    Rule("GC080", "Base image without a fixed tag", "infra", 1, "dockerfile", ("dockerfile",),
         description="The image changes under the build and is pulled again.",
         remediation="Name a version."),
    Rule("GC081", "Single stage build on a tool chain image", "infra", 1, "dockerfile", ("dockerfile",),
         description="Compilers and build files stay in the final image.",
         remediation="Build in one stage and copy the result into a small one."),
    Rule("GC082", "Package cache left in the image", "infra", 1, "dockerfile", ("dockerfile",),
         description="Caches and recommended packages make the image larger.",
         remediation="Install with --no-cache-dir or --no-install-recommends."),
    Rule("GC083", "Full base image", "infra", 1, "dockerfile", ("dockerfile",),
         description="Full images are several times larger than their slim variants.",
         remediation="Use a slim or alpine variant."),
    Rule("GC084", "ADD used for local files", "infra", 1, "dockerfile", ("dockerfile",),
         description="ADD also downloads and unpacks, which can surprise.",
         remediation="Use COPY."),
    # sci
    Rule("GC090", "Job scheduled every minute", "sci", 2, languages=("yaml", "ini", "toml"),
         pattern=r"\*\s+\*\s+\*\s+\*\s+\*", hints=("*",),
         description="The host is woken every minute whatever the grid's carbon intensity.",
         remediation="Run less often or on events."),
    Rule("GC091", "Container always on", "sci", 1, languages=("yaml",),
         pattern=r"\brestart(policy)?\s*:\s*[\"']?always\b", ignore_case=True, hints=("restart",),
         description="Resources stay reserved while nothing runs.",
         remediation="Restart on failure and scale to zero."),
    Rule("GC092", "HTTP caching disabled", "sci", 1,
         languages=("python", "javascript", "typescript", "java", "php", "ruby", "go", "csharp", "html", "yaml",
                    "json", "ini"),
         pattern=r"cache[-_ ]?control\b[^\n]*\bno-store\b", ignore_case=True, hints=("no-store",),
         linear=r"\A(?>(.*?)cache[-_ ]?control\b)[^\n]*\bno-store\b",
         description="Every request is computed and sent anew.",
         remediation="Cache what may be cached."),
    Rule("GC093", "Many fixed replicas", "sci", 1, languages=("yaml",),
         pattern=r"\breplicas\s*:\s*([4-9]|\d{2,})\b", ignore_case=True, hints=("replicas",),
         description="Capacity is reserved for a peak that is seldom there.",
         remediation="Scale with the load."),
)


def select_rules(ids: Iterable[str] | None = None, rules: Iterable[Rule] = DEFAULT_RULES) -> tuple[Rule, ...]:
    """The rules with the given ids (all of them when ``ids`` is None), in catalogue order."""
    if ids is None:
        return tuple(rules)
    wanted = set(ids)
    return tuple(r for r in rules if r.id in wanted)
