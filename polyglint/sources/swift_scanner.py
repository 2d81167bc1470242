"""Application sources (Swift) as rows: every string literal with where it stands, what it is, and the table it asks for.

Three passes over files as rows: literals(), one Arrow batch of files at a time; discoveries(), the
conventions a project declares, gathered and made distinct over all files; classify(), a ladder of
column expressions over literals joined with what was discovered.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_translatable

_set = lambda words: tuple(sorted(words.split()))

TYPES = _set("""ActionSheet Alert Button ColorPicker CommandMenu ContentUnavailableView ControlGroup DatePicker DisclosureGroup Gauge GroupBox Label
    LabeledContent Link LocalizedStringKey LocalizedStringResource Menu MultiDatePicker NSLocalizedString NavigationLink Picker ProgressView Section
    SecureField Settings ShareLink Slider Stepper Tab TableColumn Text TextEditor TextField Toggle WindowGroup""")
MODIFIERS = _set("""accessibilityHint accessibilityInputLabels accessibilityLabel accessibilityValue alert badge confirmationDialog dialogTitle
    fileDialogConfirmationLabel help navigationBarTitle navigationSubtitle navigationTitle searchable tabItem toolbarTitleMenu""")
LABELLED = {"AttributedString": "localized", "String": "localized"}
VALUE_LABELS = _set("attributes bundle comment defaultValue format locale options table tableName value verbatim")
ASSIGNED = _set("attributedText headerTitle informativeText message placeholder prompt stringValue text title toolTip")
SETTERS = _set("setMessage setPlaceholder setPrompt setTitle")
DIAGNOSTIC = "analytics|assert|breadcrumb|crash|debug|diagnostic|log|metric|pixel|telemetry|trace"


@dataclass
class Options:
    """What a project may set; each replaces the default."""

    calls: tuple[str, ...] = ()
    modifiers: tuple[str, ...] = ()
    params: tuple[str, ...] = _set("caption hint label labelKey message placeholder prompt subtitle title titleKey")
    accessors: tuple[str, ...] = _set("l10n loc localized localizedString localizedValue")
    skip_params: tuple[str, ...] = _set("""coder color contentsOfFile defaultsKey encoding font fontName forKey forResource hex host icon iconName id identifier
        image imageName key keyPath mimeType named ofType path pattern reuseIdentifier scheme separator storageKey symbol systemImage systemName tag terminator url urlString""")
    skip_calls: tuple[str, ...] = _set("""AppStorage Array Bundle CodingUserInfoKey Color Data Date DateFormatter Decimal Dictionary DispatchQueue Double Font Image Int
        Locale Logger NSError NSExpression NSImage NSLog NSPredicate NSRegularExpression NSSortDescriptor Notification NumberFormatter OSLog OSSignposter OperationQueue
        Predicate Scanner SceneStorage Set Signposter SortDescriptor Thread UIImage URL URLComponents UUID UserDefaults XCTAssertEqual XCTAssertTrue XCTAssertFalse
        XCTFail XCTSkip XCTUnwrap XCTestExpectation assert assertionFailure available debugPrint expectation fatalError os_log os_signpost precondition preconditionFailure print""")
    ignored: tuple[str, ...] = field(default=())


_PLACEHOLDER = r"%(?:(?U:\d)+\$)?[-+#0']*(?U:\d)*(?:\.(?U:\d)+)?(?:hh|ll|[hlqztjL])?[@dDiuUxXoOfFeEgGcCsS]"
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "'": "'", "\\": "\\"}


def lex(text: str):
    """(literals, code): code is the text with comments and literals blanked, place by place; a literal is a dict of value, template (interpolations
    as NUL), start, stop, line, nested, ignored."""
    code, out, ignored_lines, whole = list(text), [], set(), False
    n = len(text)

    def blank(a, b):
        for i in range(a, b):
            if code[i] not in "\r\n":
                code[i] = " "

    def comment(a, b):
        nonlocal whole
        body = text[a:b]
        if "polyglint:ignore-file" in body:
            whole = True
        elif "polyglint:ignore" in body:
            line = text.count("\n", 0, a)
            ignored_lines.update((line, line + 1) if not text[text.rfind("\n", 0, a) + 1 : a].strip() else (line,))
        blank(a, b)

    def literal(at, depth):
        """Reads a literal whose opening begins at `at`: its end."""
        hashes = 0
        while text[at + hashes] == "#":
            hashes += 1
        quote = '"""' if text.startswith('"""', at + hashes) else '"'
        i, close, esc = at + hashes + len(quote), quote + "#" * hashes, "\\" + "#" * hashes
        parts, template = [], []

        def put(s):
            parts.append(s)
            template.append(s)

        while i < n:
            if text.startswith(close, i):
                i += len(close)
                break
            if text.startswith(esc, i):
                j = i + len(esc)
                c = text[j : j + 1]
                if c == "(":
                    end = code_span(j + 1, depth + 1)
                    parts.append(text[i : end])
                    template.append("\0")
                    i = end
                elif c == "u" and text[j + 1 : j + 2] == "{" and "}" in text[j:]:
                    end = text.index("}", j)
                    digits = text[j + 2 : end]
                    put(chr(int(digits, 16)) if re.fullmatch(r"[0-9a-fA-F]{1,8}", digits) and int(digits, 16) < 0x110000 else "")
                    i = end + 1
                elif c in ("\n", "\r") and quote == '"""':
                    i = j + (2 if text.startswith("\r\n", j) else 1)
                else:
                    put(_ESCAPE.get(c, c))
                    i = j + 1
            elif quote == '"' and text[i] in "\r\n":
                break
            else:
                put(text[i])
                i += 1
        whole_text, whole_template = "".join(parts), "".join(template)
        if quote == '"""':
            whole_text, whole_template = _dedent(whole_text), _dedent(whole_template)
        out.append({"value": whole_text, "template": whole_template, "start": at, "stop": i, "line": text.count("\n", 0, at), "nested": depth > 0, "interpolated": "\0" in whole_template})
        blank(at, i)
        return i

    def code_span(i, depth):
        """Reads code; depth > 0: up to the parenthesis that closes the interpolation."""
        level = 1
        while i < n:
            if text.startswith("//", i):
                end = min((x for x in (text.find("\n", i), text.find("\r", i)) if x >= 0), default=n)
                comment(i, end)
                i = end
            elif text.startswith("/*", i):
                j, open_ = i + 2, 1
                while j < n and open_:
                    if text.startswith("/*", j):
                        open_, j = open_ + 1, j + 2
                    elif text.startswith("*/", j):
                        open_, j = open_ - 1, j + 2
                    else:
                        j += 1
                comment(i, j)
                i = j
            elif text[i] == '"' or (text[i] == "#" and re.match(r'#+"', text[i : i + 20])):
                i = literal(i, depth)
            else:
                if depth:
                    level += {"(": 1, ")": -1}.get(text[i], 0)
                    if not level:
                        return i + 1
                i += 1
        return i

    code_span(0, 0)
    for r in out:
        r["ignored"] = whole or r["line"] in ignored_lines
    return sorted(out, key=lambda r: r["start"]), "".join(code)


def _dedent(s: str) -> str:
    """A multi-line literal without its first line break, and without the last line's indent on all."""
    lines = re.split(r"\r\n|\n|\r", s)
    if len(lines) < 2:
        return s
    indent = lines[-1] if not lines[-1].strip() else ""
    return "\n".join(x[len(indent) :] if x.startswith(indent) else x.lstrip() for x in lines[1:-1])


def pattern_of(template: str) -> str:
    """A regular expression for the catalog keys that an interpolated literal may have become."""
    return _PLACEHOLDER.join(re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", part.replace("%", "%%")) for part in template.split("\0"))


def key_of(template: str) -> str:
    return "%@".join(part.replace("%", "%%") for part in template.split("\0"))


def _previews(code: str) -> list[tuple[int, int]]:
    """Spans of preview code: from a #Preview or PreviewProvider to the brace that closes it."""
    out = []
    for m in re.finditer(r"#Preview\b|\bPreviewProvider\b", code):
        at = code.find("{", m.end(), m.end() + 300)
        depth, i = 0, at
        while 0 <= i < len(code):
            depth += {"{": 1, "}": -1}.get(code[i], 0)
            i += 1
            if not depth:
                break
        if at >= 0:
            out.append((m.start(), i))
    return out


def _calls(code: str):
    """(open, close, callee, method, arguments) of every call; an argument is (start, stop, label). In the order of their opening."""
    stack, out = [], []
    for i, c in enumerate(code):
        if c in "([{":
            stack.append((c, i, [i + 1]))
        elif c == "," and stack:
            stack[-1][2].append(i + 1)
        elif c in ")]}" and stack:
            opened, at, starts = stack.pop()
            if opened == "(":
                before = code[:at].rstrip(" ") if code[max(0, at - 1) : at] == " " else code[:at]
                m = re.search(r"(\.?)\s*([A-Za-z_]\w*)(?:<[^<>()]*>)?[!?]?$", before[-160:])
                if m:
                    ends = [s - 1 for s in starts[1:]] + [i]
                    args = []
                    for s, e in zip(starts, ends):
                        label = re.match(r"\s*([A-Za-z_]\w*)\s*:(?!:)", code[s:e])
                        args.append((s, e, label[1] if label else None))
                    out.append((at, i, m[2], m[1] == ".", args))
    return sorted(out)


LITERAL = "path string, value string, line int, start int, stop int, is_nested boolean, ignored boolean, in_preview boolean, format_key string, format_pattern string, head string, callee string, is_method boolean, argument int, label string, table_name string, dynamic_table boolean, concatenated boolean, assigned string, member string"
_LITERAL_NAMES = [c.split()[0] for c in LITERAL.split(", ")]


def literals_of(path: str, text: str) -> list[dict]:
    found, code = lex(text)
    calls, previews = _calls(code), _previews(code)
    by_start = {r["start"]: r for r in found}
    rows = []
    for r in found:
        row = dict.fromkeys(_LITERAL_NAMES)
        row |= {"path": path, "value": r["value"], "line": r["line"] + 1, "start": len(text[: r["start"]].encode()), "stop": len(text[: r["stop"]].encode()), "is_nested": r["nested"], "ignored": r["ignored"], "in_preview": any(a <= r["start"] < b for a, b in previews), "is_method": False, "dynamic_table": False}
        if r["interpolated"]:
            row |= {"format_key": key_of(r["template"]), "format_pattern": pattern_of(r["template"]), "head": r["template"].split("\0")[0].replace("%", "%%")}
        inside = [c for c in calls if c[0] < r["start"] < c[1]]
        if inside:
            _, _, callee, method, args = inside[-1]
            k, (s, e, label) = next((k, a) for k, a in enumerate(args) if a[0] <= r["start"] <= a[1])
            row |= {"callee": callee, "is_method": method, "argument": k, "label": label}
            for s2, e2, other in args:
                if other in ("table", "tableName") and s2 != s:
                    own = [x for x in by_start.values() if s2 <= x["start"] < e2]
                    if own:
                        row["table_name"] = own[0]["value"]
                    elif code[s2:e2].split(":", 1)[1].strip() != "nil":
                        row["dynamic_table"] = True
        else:
            m = re.search(r"\.?([A-Za-z_]\w*)\s*=\s*$", code[max(0, r["start"] - 120) : r["start"]])
            row["assigned"] = m[1] if m else None
        after, before = code[r["stop"] : r["stop"] + 60], code[max(0, r["start"] - 20) : r["start"]].rstrip()
        m = re.match(r"\s*\.([A-Za-z_]\w*)", after)
        row["member"] = m[1] if m else None
        row["concatenated"] = before.endswith("+") or after.lstrip().startswith("+")
        rows.append(row)
    return rows


FOUND = "kind string, name string, owner string"


def discoveries_of(text: str) -> list[dict]:
    """Conventions that a file declares: types; parameters of a type that it passes on to localization; unlabelled first parameters; wrapper functions."""
    found, code = lex(text)
    out = []
    for m in re.finditer(r"\b(?:extension|struct|enum|class|actor)\s+([A-Z]\w*)[^{}]*\{", code):
        end, depth = m.end(), 1
        while end < len(code) and depth:
            depth += {"{": 1, "}": -1}.get(code[end], 0)
            end += 1
        name, body = m[1], code[m.end() : end]
        out.append({"kind": "type", "name": name, "owner": None})
        typed = set(re.findall(r"\b(?:let|var)\s+(\w+)\s*:\s*Localized(?:StringKey|StringResource)\b", body))
        plain = set(re.findall(r"\b(?:let|var)\s+(\w+)\s*:\s*String\b", body))
        passed = set(re.findall(r"\b(?:LocalizedStringKey|LocalizedStringResource|NSLocalizedString)\s*\(\s*(\w+)", body)) | set(re.findall(r"\blocalized\s*:\s*(?:\.init\(\s*)?(\w+)", body))
        for p in typed | (plain & passed):
            out.append({"kind": "parameter", "name": p, "owner": name})
        for p in re.findall(r"\binit\s*\(\s*_\s+(\w+)\s*:", body):
            if p in typed | (plain & passed):
                out.append({"kind": "initializer", "name": name, "owner": None})
    for m in re.finditer(r"\bfunc\s+(\w+)(?:<[^<>(]*>)?\s*\(\s*_\s+(\w+)\s*:\s*(String|LocalizedStringKey|LocalizedStringResource)\b[^{}]*\{", code):
        end, depth = m.end(), 1
        while end < len(code) and depth:
            depth += {"{": 1, "}": -1}.get(code[end], 0)
            end += 1
        p = re.escape(m[2])
        if m[3] != "String" or re.search(rf"(?:NSLocalizedString|LocalizedStringKey|LocalizedStringResource)\s*\(\s*{p}\b|localized\s*:\s*(?:\.init\(\s*)?{p}\b|localizedString\s*\(\s*forKey\s*:\s*{p}\b", code[m.end() : end]):
            out.append({"kind": "function", "name": m[1], "owner": None})
    return out


def read_sources(spark: SparkSession, root: str, extension: str = "swift") -> DataFrame:
    """(path, text) of all sources below root, a row each; files that aren't UTF-8 have text null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").load(root)
    return files.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("text"))


def _rows(files: DataFrame, make, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches):
        for b in batches:
            rows = [r for path, text in zip(b["path"], b["text"]) if text is not None for r in make(path, text)]
            if rows:
                frame = pd.DataFrame(rows, columns=names)
                yield frame.astype({c: "Int32" for c in ("line", "start", "stop", "argument") if c in names})

    return files.select("path", "text").mapInPandas(work, schema)


def literals(files: DataFrame) -> DataFrame:
    return _rows(files, literals_of, LITERAL)


def discoveries(files: DataFrame) -> DataFrame:
    return _rows(files, lambda _, text: discoveries_of(text), FOUND).distinct()


def is_test_code(path, code):
    """Columns: files that only tests compile."""
    return code.rlike(r"(?m)^\s*(@testable\s+import|import\s+(XCTest|Testing)\b)") | path.rlike(r"(Tests?|Specs?)\.swift$|/[^/]*(UITests|Tests)/")


def classify(found: DataFrame, discovered: DataFrame, options: Options | None = None) -> DataFrame:
    """literals with role (key, bypass or ignored), confidence and context; the first rung of the ladder that fits decides."""
    o = options or Options()
    names = lambda kind: discovered.where(F.col("kind") == kind).select(F.col("name").alias("callee")).distinct()
    rows = found
    for kind in ("type", "initializer", "function"):
        rows = rows.join(names(kind).withColumn(f"is_{kind}", F.lit(True)), "callee", "left")
    owners = discovered.where("kind = 'parameter'").select(F.col("name").alias("label"), F.col("owner").alias("callee")).distinct().withColumn("owned", F.lit(True))
    rows = rows.join(owners, ["label", "callee"], "left")
    c, label, yes = F.col("callee"), F.col("label"), lambda n: F.coalesce(F.col(n), F.lit(False))
    among = lambda col, values: F.coalesce(col.isin(*values), F.lit(False)) if values else F.lit(False)
    first, method = (F.col("argument") == 0) & label.isNull(), F.col("is_method")
    role = lambda name, sure=None: F.struct(F.lit(name).alias("role"), F.lit(sure).cast("string").alias("confidence"))
    strong, weak, bypass, none = role("key", "strong"), role("key", "weak"), role("bypass"), role("ignored")
    labelled = F.lit(False)
    for callee, key in LABELLED.items():
        labelled = labelled | F.coalesce((c == callee) & (label == key), F.lit(False))
    decided = (
        F.when(F.col("is_nested"), none)
        .when(F.coalesce(label == "verbatim", F.lit(False)), bypass)
        .when(among(label, o.skip_params) | among(c, o.skip_calls) | among(label, VALUE_LABELS), none)
        .when(among(F.col("member"), o.accessors), strong)
        .when(labelled, strong)
        .when(first & ~method & among(c, (*TYPES, *o.calls)), strong)
        .when(first & method & among(c, (*MODIFIERS, *o.modifiers)), strong)
        .when(first & ~method & yes("is_initializer"), weak)
        .when(first & yes("is_function"), strong)
        .when(first & method & among(c, SETTERS), bypass)
        .when(c.isNull() & among(F.col("assigned"), ASSIGNED), bypass)
        .when(yes("owned"), weak)
        .when(label.isNotNull() & yes("is_type"), none)
        .when(among(label, o.params) & F.coalesce(F.lower(c).rlike(DIAGNOSTIC), F.lit(False)), none)
        .when(among(label, o.params), weak)
        .otherwise(none)
    )
    return rows.withColumn("_d", decided).select(*found.columns, F.col("_d.role").alias("role"), F.col("_d.confidence").alias("confidence"))


def found_strings(classified: DataFrame, options: Options | None = None, previews: bool = False) -> DataFrame:
    """The keys among classified literals that a user would see: (path, line, value, table_name, is_format_key, format_pattern, head)."""
    o = options or Options()
    value = F.coalesce("format_key", "value")
    number = value.try_cast("double").isNotNull()
    identifier = (F.col("confidence") == "weak") & value.rlike(r"^\p{Ll}[\p{L}\p{N}]*$")
    ok = ~F.col("ignored") & (F.char_length(value) > 1) & ~number & is_translatable(value) & ~identifier
    if not previews:
        ok = ok & ~F.col("in_preview")
    out = classified.where((F.col("role") == "key") & ok & ~F.col("dynamic_table") & ~F.col("concatenated"))
    if o.ignored:
        out = out.where(~value.isin(*o.ignored))
    return out.select("path", "line", value.alias("value"), F.coalesce("table_name", F.lit("Localizable")).alias("table_name"), F.col("format_pattern").isNotNull().alias("is_format_key"), "format_pattern", "head")


def bypasses(classified: DataFrame) -> DataFrame:
    return classified.where((F.col("role") == "bypass") & ~F.col("ignored") & ~F.col("in_preview") & is_translatable(F.col("value"))).select("path", "line", "value", "callee", "assigned")
