"""Template residue, filler, error pages and script notices in documents."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderloom.llm.text import INVISIBLE, WIDE_SPACE, let, shingles, visible, words
from cinderloom.session import ensure_checkpoint_dir

#: Markup and project tags, which are no slots.
TAGS = "VIDEO|IMAGE|AUDIO|THINK|ANSWER|EVENTS|HTML|HEAD|BODY|P|BR|B|I|U|A|UL|OL|LI|DIV|SPAN|H[1-6]|TABLE|TR|TD|EM|STRONG|PRE|CODE|NOSCRIPT|SCRIPT|STYLE|META|LINK|TITLE_TAG"

#: Slots of the usual template languages, and slots for people to fill in, each after the signs of which a text with one
#: holds one. Case counts in the patterns, not in the signs.
SLOTS = [
    ("{{", r"\{\{\s*\w+\s*\}\}"), ("${ #{", r"[$#]\{\w+\}"), ("{%", r"\{%\s*\w+\s*%\}"), ("<%", r"<%=?\s*\w+\s*%>"), ("%(", r"%\(\w+\)[sdfi]"), ("[[", r"\[\[\s*\w+\s*\]\]"), ("<<", r"<<\s*\w+\s*>>"), ("@@", r"@@\w+@@"),
    ("__", r"(?<![A-Za-z0-9])__[A-Za-z][A-Za-z_]*__(?![A-Za-z0-9])"), ("__", r"(?i:\b(?:dear|hello|hi|order of|signed|name:|date:)\s+_{3,})"), ("{", r"(?<![\w}{^$#\\\"'])\{[A-Za-z_]\w*(?::[^{}\s\"]*)?\}(?!\})"),
    ("[", r"(?i:\[\s*(?:insert|your|add|enter|fill in)\s[^\]\n]+\])"), ("(insert (add (enter (fill", r"(?i:\(\s*(?:insert|add your|enter|fill in)\s[^)\n]+\))"), ("[", r"\[[A-Z]{3,}(?:_[A-Z]+)*\]"),
    ("<", rf"<(?!/?(?:{TAGS})\b)[A-Z]{{2,}}(?:_[A-Z]+)*>"), ("xxxx", r"\bX{4,}\b"), ("todo:", r"(?i:\btodo:\s*(?:add|insert|fill))"), ("tbd", r"\bTBD\b"),
]

#: Words of the usual Latin filler.
LATIN = "lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|eiusmod|tempor|incididunt|labore|dolore|magna|aliqua|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|commodo|consequat|duis|aute|irure|reprehenderit|voluptate|velit|esse|cillum|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|proident|sunt|culpa|officia|deserunt|mollit|anim|laborum|lectus|ornare|augue|felis|massa|porta|vitae"

_THING = r"(?:text|transcript|paragraph|sentence|caption|description|summary|title|content|heading)"
#: Each pattern after the words of which a text with one holds one, or as many as the number says.
FILLER = [
    (LATIN.replace("|", " "), 4, rf"(?:\b(?:{LATIN})\b[\s,.]*+){{4,}}"),
    ("asdf qwer zxcv hjkl lkjh sdfg dfgh foo bar baz qux aaa bbb xxx blah test text", 3, r"(?:\b(?:asdf|qwer|qwerty|zxcv|hjkl|lkjh|sdfg|dfgh|foo|bar|baz|qux|a{3,}|b{3,}|x{3,}|blah|test|text)\b[\s,.\d]*+){3,}"),
    ("dummy placeholder filler", 1, rf"\b(?:this is (?:a )?)?(?:dummy|placeholder|filler) {_THING}\b"), ("sample example", 1, rf"(?:^|[.!?]\s+)(?:sample|example) {_THING}(?: (?:\d+|goes here)| for layout)"),
    ("here soon follow added to#come", 1, rf"\b{_THING} (?:goes here|coming soon|will follow|to follow|to be added|will be added|to come)\b"), ("this#space follow click", 1, r"\bwill appear in this space\b|\bmore to follow\b|\bclick to edit this\b"),
    ("your", 1, rf"(?:^|[.!?]\s+|\n)\s*your {_THING} here\b"), ("hier platzhaltertext", 1, r"\bhier steht später\b|\bhier folgt\b|\bplatzhaltertext\b"), ("填写 占位 示例", 1, r"此处填写|此处为占位|示例文本|占位文本"),
    ("texto", 1, r"\btexto de (?:ejemplo|exemplo|relleno)\b"), ("texte", 1, r"\btexte (?:d['’]exemple|à venir|de remplissage)\b"), ("здесь пример", 1, r"здесь будет (?:текст|описание)|пример текста"),
]

_STATUS = r"(?:bad request|unauthorized|payment required|forbidden|not found|method not allowed|request timeout|conflict|gone|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)"
_STATUSES = "request unauthorized required forbidden found allowed timeout time-out conflict gone error implemented gateway unavailable"
_FAULT = r"(?:gateway time-?out|bad gateway|service unavailable|internal server error|connection (?:timed out|refused|reset)|request (?:timed out|failed|blocked)|upstream (?:error|failure)|(?:rate|request) limit (?:reached|exceeded))"
#: Objects that hold an error are looked for before quotations are dropped, as their keys stand in quotation marks.
ERROR_OBJECTS = [('"error"', 1, r"(?:^|\n)\s*\{\s*\"error\"\s*:\s*[{\"]")]
ERRORS = [
    (_STATUSES, 1, rf"(?:^|[.!?>]\s+|\n)\s*(?:http(?:/[\d.]+)?[ :]+|error:?\s+)?[45]\d\d\b\W{{1,4}}{_STATUS}"), (_STATUSES + " denied", 1, rf"(?:^|\n)\s*(?:{_STATUS}|access denied|page not found)[.!]?\s*(?:\n|$)"),
    ("gateway unavailable error connection request upstream limit", 1, rf"(?:^|\n|[.!?]\s+){_FAULT} (?:while|when|for|on|from|at)\b"),
    ("http error", 1, r"(?:^|\n)\s*(?:http(?:/[\d.]+)?|error:?)\s+[45]\d\d\b"), ("permission", 1, r"\byou don['’]t have permission to (?:view|access|see)\b"), ("this#page", 1, r"\bthis page isn['’]t available\b"),
    ("oops", 1, r"(?:^|\n|[.!?]\s+)oops\b[^\n]*\b(?:page|find|found|wrong)\b"), ("find", 1, r"(?:^|\n|[.!?]\s+)(?:sorry, )?(?:we|the server) (?:couldn['’]t|could not|can['’]t|cannot) find (?:that|this|the) page\b"),
    ("removed", 1, r"\bthis (?:video|page|post|content|item) (?:has been|was) (?:removed|deleted|taken down)\b"), ("longer not#available", 1, r"\bthis (?:content|video|page|clip|item) is (?:no longer|not) available in your (?:region|country|area)\b"),
    ("unavailable", 1, r"(?:^|\n|[.!?]\s+)video unavailable\."), ("session", 1, r"\byour session has expired\b"), ("failed", 1, r"\bfor this video failed to load\b"), ("wrong", 1, r"(?:^|\n|[.!?]\s+)something went wrong while\b"),
    ("returned", 1, r"\bthe server returned status \d"), ("persists", 1, r"\bif the problem persists, (?:tell|contact)\b"), ("checking", 1, r"\bchecking your browser before\b"), ("limited", 1, r"\byour address has been limited\b"), ("request#id", 1, r"(?:^|\n)\s*request id \d+\s*(?:\n|$)"),
    ("seite", 1, r"\bseite (?:wurde )?nicht gefunden\b"), ("encontrada", 1, r"\bpágina no encontrada\b|\bpágina não encontrada\b"), ("页面 服务器", 1, r"页面不存在|找不到页面|服务器错误"), ("introuvable erreur", 1, r"\bpage introuvable\b|\berreur \d+\s*:"),
    ("fehler", 1, r"\bfehler \d{3}\b"), ("не#найдена ошибка", 1, r"страница не найдена|ошибка \d{3}"), ("erro", 1, r"\b(?:error|erro) \d{3}\s*:"),
]

_NEEDS = r"(?:javascript|java script|scripts?|scripting|cookies?|active content)"
_NEEDED = "script cookie active#content"
NOTICES = [
    (_NEEDED, 1, rf"\b(?:please|kindly|you need to|you must|you have to|to continue,?)\s(?:[\w']+\s){{0,3}}?(?:enable|allow|activate|accept|turn on|switch on)\b[^.\n]*?\b{_NEEDS}\b"), (_NEEDED, 1, rf"(?:^|\n|[.!?]\s+)(?:enable|allow|activate|turn on|switch on)\s{_NEEDS}\b"),
    (_NEEDED, 1, rf"(?:^|\n|[.!?]\s+)(?:turn|switch) {_NEEDS} on\b"), (_NEEDED, 1, rf"(?:^|\n|[.!?]\s+){_NEEDS}(?: and {_NEEDS})? (?:(?:is|are) )?(?:required|disabled|needed|turned off|blocked)\b"),
    (_NEEDED, 1, rf"\bthis (?:page|site|website|player|viewer|transcript|app|application|video) (?:requires?|needs?|(?:does not|doesn['’]t|will not|won['’]t) work without)\s{_NEEDS}\b"),
    ("cookies", 1, r"(?:^|\n|[.!?]\s+)we use cookies\b"), ("browser", 1, r"\byour browser (?:is not supported|blocks|seems to block|has scripting turned off|does not support)\b"), ("without", 1, r"\bwill not load without (?:them|scripts)\b"),
    ("javascript", 1, r"\bactive javascript para\b|\bhabilite (?:el )?javascript\b|\b(?:ative|habilite) o javascript\b"), ("启用", 1, r"请启用(?:脚本|\s*javascript|\s*cookie)|需要启用"), ("script cookies", 1, r"\b(?:veuillez activer|activez) (?:javascript|les scripts|les cookies)\b"),
    ("javascript cookies", 1, r"\bjavascript (?:aktivieren|erforderlich)\b|\baktivieren sie (?:javascript|cookies)\b"), ("включите", 1, r"включите (?:javascript|скрипты|cookie)"),
]

#: Loosened forms of every pattern above, list by list: what a text that trusted residue is passed on to must hold one of.
LOOSE_SLOTS = [
    r"\{\{|\}\}|[$#]\{|\{%|%\}|<%|%>|%\(\w|\[\[|\]\]|<<|>>|@@|__\w|\w__|\{\s*[A-Za-z_]|\w\s*\}",
    rf"(?i:[\[(<]\s*(?:insert|your|add|enter|fill|todo|tbd)\b)|\[[A-Z]{{3,}}|<(?!/?(?:{TAGS})\b)[A-Z]{{2,}}", r"(?i:\b(?:x{3,}|todo|tbd)\b)",
]
LOOSE_FILLER = [
    rf"\b(?:lorem|ipsum|consectetur|adipiscing)\b|(?:\b(?:{LATIN})\b[\s,.]*+){{2,}}", r"\b(?:asdf|qwer|zxcv|hjkl)\w*|\b(?:lkjh|sdfg|dfgh|qux|blah|a{3,}|b{3,})\b|(?:\b(?:foo|bar|baz|test|text)\b[\s,.\d]*+){2,}",
    rf"\b(?:dummy|placeholder|filler)\b|\b(?:sample|example) (?:\w+ )?{_THING}\b", rf"\b{_THING}\s(?:\w+\s){{0,3}}?(?:here|soon|later|follows?|added|written|come|coming)\b",
    r"\bappears? in this space\b|\b(?:goes|go) here\b|\bcoming soon\b|\b(?:to|will) follow\b|\bnot written yet\b", r"\bhier (?:steht|folgt|kommt)\b|platzhalter|beispieltext",
    r"此处|占位|示例", r"\btexto (?:de|do|del) (?:ejemplo|exemplo|relleno|muestra|prueba)\b", r"\btexte (?:\w+ )?(?:d['’]exemple|à venir|de remplissage|provisoire)", r"здесь (?:\w+ )?будет|пример\w* текст",
]
LOOSE_ERRORS = [
    rf"{_STATUS}|\b[45]\d\d\b|\b(?:error|erro|erreur|fehler)\b|ошибк", r"\baccess (?:is |was )?denied\b|\bpermission to\b|\b(?:isn['’]t|is not|not) available\b|\bunavailable\b", r"\bsession (?:has |is |was )?(?:expired|timed out|ended)\b",
    r"\bfailed to load\b|\b(?:could|can|did)(?: ?not|n['’]t) (?:be )?load", r"\bwent wrong\b|\bserver (?:returned|responded|error)\b|\bproblem persists\b|\bchecking your browser\b|\baddress has been\b|\brequest id\b",
    r"\bnicht gefunden\b|\b(?:no|não) (?:fue |foi )?encontrad[ao]\b|\bintrouvable\b|не найден|页面|找不到|服务器",
]
LOOSE_NOTICES = [rf"\b{_NEEDS}\b|javascript|\byour browser\b|\bwill not load without\b|脚本|启用|скрипт|\bcookie"]


def _any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def repaired(text: Column) -> Column:
    """UTF-8 that was once read as Latin-1, put right where that gives valid text."""
    narrow = text.rlike(r"^[\x00-\xff]*$") & text.rlike(r"[\xc2-\xf4][\x80-\xbf]")
    return F.coalesce(F.when(narrow, F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string"))), text)


def weak_residue(text: Column) -> Column:
    """Whether a text holds at least a loose sign of residue, wherever it stands."""

    def judged(said: Column) -> Column:
        low = F.regexp_replace(F.lower(said), r"[ \t]+", " ")
        return _any(said, LOOSE_SLOTS) | let(low, lambda p: _any(p, LOOSE_FILLER) | _any(p, LOOSE_ERRORS) | _any(p, LOOSE_NOTICES))

    return F.coalesce(let(visible(repaired(text)), judged), F.lit(False))


def masked_words(text: Column) -> Column:
    """The words of a text with digits masked, in one string: texts that agree here are copies."""
    return F.array_join(words(F.regexp_replace(F.coalesce(text, F.lit("")), r"\d+", "0")), " ")


def _span_finder():
    """What makes, on a worker, the function that finds a text's residue. Nested, so that workers get it by value."""
    slots = [(signs.split(), pattern) for signs, pattern in SLOTS]
    spoken = [(signs.replace("#", "\0").split(), least, pattern) for signs, least, pattern in FILLER + ERRORS + NOTICES]
    objects = [p for _, _, p in ERROR_OBJECTS]

    def made():
        import re

        ascii_slots = [(sign, re.compile(pattern, re.A)) for signs, pattern in slots for sign in signs]
        patterns = [(least, re.compile(pattern, re.A)) for _, least, pattern in spoken]
        error_objects = [re.compile(p, re.A) for p in objects]
        signs: dict[str, list[int]] = {}
        for k, (words, _, _) in enumerate(spoken):
            for w in words:
                signs.setdefault(w.replace("\0", " "), []).append(k)
        try:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for w, which in signs.items():
                machine.add_word(w, which)
            machine.make_automaton()

            def hits(p):
                count: dict[int, int] = {}
                for _, which in machine.iter(p):
                    for k in which:
                        count[k] = count.get(k, 0) + 1
                return count
        except ImportError:

            def hits(p):
                count: dict[int, int] = {}
                for w, which in signs.items():
                    n = p.count(w) if w in p else 0
                    for k in which if n else ():
                        count[k] = count.get(k, 0) + n
                return count

        invisible = re.compile(INVISIBLE)
        wide = re.compile(WIDE_SPACE)
        markup = re.compile(r"(?i)<br\s*/?>|</?(?:html|body|head|h[1-6]|p|div|span|b|i|em|strong|ul|li)(?:\s[^<>]*)?>")
        code = re.compile(r"(?s)```.*?(?:```|$)|`[^`\n]*`")
        quoted = re.compile(r"(?m)^\s*>.*$|\"[^\"\n{}]+\"|“[^”\n]+”")
        blanks = re.compile(r"[ \t]+")
        mojibake = re.compile("[\xc2-\xf4][\x80-\xbf]")

        def spans(text):
            """Residue in a text: pairs of the cleaned text it stands in and its place there."""
            if not text.isascii():
                text = wide.sub(" ", invisible.sub("", text))
                if mojibake.search(text):
                    try:
                        text = text.encode("latin-1").decode("utf-8")
                    except (UnicodeEncodeError, UnicodeDecodeError):
                        pass
            said = markup.sub("\n", text) if "<" in text else text
            said = code.sub(" ", said) if "`" in said else said
            low = said.lower()
            out = []
            for sign, p in ascii_slots:
                if sign in low:
                    out += [(said, m.span()) for m in p.finditer(said)]
            out += [(low, m.span()) for p in error_objects if '"error"' in low for m in p.finditer(low)]
            plain = quoted.sub(" ", said).lower() if '"' in said or ">" in said or "“" in said else low
            plain = blanks.sub(" ", plain) if "  " in plain or "\t" in plain else plain
            count = hits(plain)
            return out + [(plain, m.span()) for k, n in count.items() if n >= patterns[k][0] for m in patterns[k][1].finditer(plain)]

        return spans

    return made


def trusted_residue(text: Column) -> Column:
    """Whether a text itself holds residue; false for null."""
    find_spans = _span_finder()

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        spans = find_spans()
        return pd.Series([t is not None and bool(spans(t)) for t in texts], dtype="bool")

    return holds(text)


MINIMA = 6
WIDTH = 5
PRINT = "doc_id long, id long, simhash long, minima array<long>, n long, trusted boolean, marks array<long>"


def fingerprints(documents: DataFrame) -> DataFrame:
    """PRINT of every text of ``documents(doc_id, text)`` that isn't null or empty, by one pass over whole texts.

    ``id`` stands for the text's masked words, so copies share it; ``simhash`` and ``minima`` (the least of
    its WIDTH-word shingles under MINIMA hash functions) are made from the ``n`` distinct shingles.
    ``trusted`` tells whether the text itself holds residue, ``marks`` are then the shingles that
    cover it. Code, quoted lines and quotations only mention things and hold none.
    An Arrow-batched function: literal signs say which few patterns a text must be tried with.
    """
    find_spans, minima, width = _span_finder(), MINIMA, WIDTH

    def found(batches):
        import re

        import numpy as np
        import pandas as pd
        import regex
        import xxhash

        spans = find_spans()
        word = regex.compile(r"(?V1)[\p{Han}\p{Hiragana}\p{Katakana}]|[[\p{L}\p{N}]--\p{Han}]+")
        odd = np.uint64(0x9E3779B97F4A7C15)
        salts = np.array([(0xD6E8FEB86659FD93 * (2 * j + 1)) % 2**64 for j in range(minima)], dtype=np.uint64)
        seen: dict[str, int] = {}

        def digits(text):
            return re.sub(r"\d+", "0", text, flags=re.A).lower()

        def marks(where, tokens):
            """The text's own shingles that hold a word of the residue."""
            own = {" ".join(tokens[i : i + width]) for i in range(max(1, len(tokens) - width + 1))}
            out = set()
            for text, (start, end) in where:
                middle = word.findall(digits(text[start:end]))
                before = word.findall(digits(text[max(0, start - 400) : start]))[-(width - 1) :]
                after = word.findall(digits(text[end : end + 400]))[: width - 1]
                run = before + middle + after
                for i in range(max(1, len(run) - width + 1)):
                    if i < len(before) + len(middle) and i + width > len(before):
                        out.add(" ".join(run[i : i + width]))
            return [(x := xxhash.xxh64_intdigest(s, 42)) - (x >> 63 << 64) for s in sorted(out & own)]

        for batch in batches:
            rows = []
            for doc, text, norm in zip(batch["doc_id"], batch["text"], batch["norm"]):
                tokens = norm.split(" ")
                if len(seen) > 200_000:
                    seen.clear()
                h = np.array([seen[t] if t in seen else seen.setdefault(t, xxhash.xxh64_intdigest(t)) for t in tokens], dtype=np.uint64)
                n = max(1, len(h) - width + 1)
                mixed = np.zeros(n, dtype=np.uint64)
                for k in range(min(width, len(h))):
                    mixed = (mixed * odd) ^ h[k : k + n]
                    mixed ^= mixed >> np.uint64(29)
                mixed = np.unique(mixed * odd)
                ones = np.zeros(64, dtype=np.int64)
                for at in range(0, len(mixed), 1 << 16):
                    ones += np.unpackbits(mixed[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                bits = np.packbits(ones * 2 > len(mixed)).view(np.int64)[0]
                turned = mixed[None, :] * salts[:, None]
                least = (turned ^ (turned >> np.uint64(31))).min(axis=1).view(np.int64).tolist()
                where = spans(text)
                rows.append((doc, xxhash.xxh64_intdigest(norm) - 2**63, int(bits), least, len(mixed), bool(where), marks(where, tokens) if where else []))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PRINT.split(", ")])

    texts = documents.where("text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text", masked_words(F.col("text")).alias("norm"))
    return texts.mapInPandas(found, PRINT)


def partitioned_tables(classes: DataFrame, hot: int = 1000) -> DataFrame:
    """``key, id, simhash, n`` of ``classes(id, simhash, minima, n)``: the SimHash tables, one per minimum.

    A table is partitioned by the minimum's value, so only texts that share a shingle meet, and near-duplicates
    of similarity 0.8 meet in one of six tables but for 0.2 ** 6. A partition of more than ``hot`` classes
    is split by the class's other minima; near-duplicates in it meet again but for 0.2 ** 5.
    """
    every = F.transform("minima", lambda m, j: F.struct(F.xxhash64(j, m).alias("key"), j.alias("j")))
    keyed = classes.select("id", "simhash", "n", "minima", F.explode(every).alias("t")).select("t.key", "t.j", "id", "simhash", "n", "minima")
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > hot).select("key", F.lit(True).alias("crowded"))
    others = F.transform("minima", lambda m, k: F.when(k != F.col("j"), F.xxhash64("key", k, m)))
    keys = F.when(F.col("crowded"), F.array_compact(others)).otherwise(F.array("key"))
    return keyed.join(crowded, "key", "left").select(F.explode(keys).alias("key"), "id", "simhash", "n")


def neighbours(ids: DataFrame, tables: DataFrame, similarity: float = 0.8, distance: int = 20) -> DataFrame:
    """Candidate pairs ``a, b`` with ``a`` of ``ids(id)``: rows of a partition whose SimHashes differ in at most ``distance`` bits.

    Texts of the similarity have a Hamming distance of 10 on average, with a deviation of 3.
    """
    here = tables.join(ids.select("id"), "id", "left_semi").select("key", F.col("id").alias("a"), F.col("simhash").alias("ha"), F.col("n").alias("na"))
    there = tables.select("key", F.col("id").alias("b"), F.col("simhash").alias("hb"), F.col("n").alias("nb"))
    alike_size = F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb")
    near = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))) <= distance
    return here.join(there, "key").where((F.col("a") != F.col("b")) & alike_size & near).select("a", "b").distinct()


def alike(pairs: DataFrame, texts: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The pairs ``a, b, marks`` whose texts ``texts(id, norm)`` have a Jaccard similarity of WIDTH-word shingles of at least
    ``similarity``; of ``marks`` those stay that are shingles of ``b`` too."""
    side = lambda name: texts.select(F.col("id").alias(name), F.col("norm").alias(f"n{name}"))
    both = F.struct(shingles(F.split("na", " "), WIDTH).alias("a"), shingles(F.split("nb", " "), WIDTH).alias("b"))

    def close(s: Column) -> Column:
        common = F.size(F.array_intersect(s["a"], s["b"]))
        return let(common, lambda n: F.when(n >= F.lit(similarity) * (F.size(s["a"]) + F.size(s["b"]) - n), F.array_intersect(F.col("marks"), s["b"])))

    found = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", let(both, close))
    return found.where("shared is not null").select("a", "b", F.col("shared").alias("marks"))


def near_duplicates(documents: DataFrame, similarity: float = 0.8) -> DataFrame:
    """All verified near-duplicate pairs ``a < b`` of class ids, with ``documents(doc_id, text)``."""
    prints = fingerprints(documents)
    classes = text_classes(prints)
    pairs = neighbours(classes, partitioned_tables(classes), similarity).where("a < b").withColumn("marks", F.expr("cast(array() as array<bigint>)"))
    return alike(pairs, class_texts(classes, documents), similarity).select("a", "b")


def text_classes(prints: DataFrame) -> DataFrame:
    """The classes of copies, ``id, simhash, minima, n, first_doc``."""
    return prints.groupBy("id").agg(F.first("simhash").alias("simhash"), F.first("minima").alias("minima"), F.first("n").alias("n"), F.min("doc_id").alias("first_doc"))


def class_texts(classes: DataFrame, documents: DataFrame) -> DataFrame:
    """``id, norm``: the masked words of each class, from one of its documents."""
    firsts = classes.select("id", F.col("first_doc").alias("doc_id"))
    # A doc_id that occurs again with another text gives that text too; links then hold by either.
    return firsts.join(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").select("id", masked_words(F.col("text")).alias("norm"))


def reach(classes: DataFrame, tables: DataFrame, seeds: DataFrame, documents: DataFrame) -> DataFrame:
    """``id, marks`` of every class in a near-duplicate component that holds one of ``seeds(id, marks)``.

    The label goes outward from the seeds, and a link is verified by its texts when the label arrives at
    one of its ends, until no class is new: the components come out whole, and links that no label
    can use cost nothing. ``marks`` are the residue's shingles still shared; of several neighbours
    the one that shares most counts. Each round is checkpointed.
    """
    known = frontier = seeds.select("id", "marks").checkpoint()
    while True:
        tried = neighbours(frontier, tables).join(known.select(F.col("id").alias("b")), "b", "left_anti").checkpoint()
        if tried.isEmpty():
            return known
        wanted = tried.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        pairs = tried.join(frontier.withColumnRenamed("id", "a"), "a")
        met = alike(pairs, class_texts(classes.join(wanted, "id", "left_semi"), documents))
        fresh = met.groupBy("b").agg(F.max_by("marks", F.struct(F.size("marks"), "a")).alias("marks")).select(F.col("b").alias("id"), "marks").checkpoint()
        if fresh.isEmpty():
            return known
        known, frontier = known.unionByName(fresh).checkpoint(), fresh


def residue_documents(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the documents of ``documents(doc_id, text)`` that are residue.

    Trusted labels come from patterns over whole texts. Copies, texts equal but for case,
    punctuation, spacing and digits, form one class; near-duplicate classes are linked, and labels pass
    through the components of links. A clean original may be a near copy of its unfilled
    template, so a label counts for texts that share the residue's own shingles with the text
    it came from, or hold at least a loose sign of residue. Null and empty texts are never residue;
    a doc_id that occurs again is judged row by row and given once.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = fingerprints(documents).checkpoint()
    trusted = prints.where("trusted").select("doc_id")
    seeds = prints.where("trusted").groupBy("id").agg(F.max_by("marks", F.size("marks")).alias("marks"))
    classes = text_classes(prints)
    reached = reach(classes, partitioned_tables(classes).checkpoint(), seeds, documents)
    arrived = prints.where("not trusted").select("doc_id", "id").join(reached, "id").select("doc_id", (F.size("marks") > 0).alias("shares"))
    # A generator rather than a filter, which would be pushed below the join and try the loose signs on every text.
    counts = F.when(F.col("shares") | weak_residue(F.col("text")), F.array("doc_id"))
    passed = documents.join(arrived, "doc_id").select(F.explode(counts).alias("doc_id"))
    return trusted.unionByName(passed.select("doc_id")).distinct()
