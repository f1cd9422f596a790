"""Question and answer pairs marked as sound or with their type of defect.

Both texts are brought to one consistent form first. Then, in this order: an answer of marks and
placeholders only is ``empty``; greedy string tiling tells an answer that gives back the question,
``copy``; a grammar of sentences tells one that only declines, ``refusal``; scripts and function
words tell the ``wrong_language``; and a pushdown parser of fences, brackets, quotations, lists and
tables tells whether an answer is complete or ``truncated``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.arrowtext import in_parts
from pageloom.llm.unify import unify_array

# ---- empty -------------------------------------------------------------------------------------
# What stands for an answer that isn't there, without marks and in lower case.
PLACEHOLDERS = set(
    "n a|na|none|null|nil|nan|tbd|tba|tbc|todo|pending|no answer|empty|not available|not applicable|no data|placeholder|lorem ipsum|xxx|"
    "keine antwort|k a|keine angabe|leer|offen|aucune|aucune réponse|sans réponse|vide|sin respuesta|ninguna|vacío|sem resposta|nenhuma|vazio|нет ответа|нет данных|пусто|无|暂无|空|无答案|没有答案|待定|待补充|未填写|略".split("|")
)
_TAG = regex.compile(r"<[^<>]{0,40}>")
_FENCE_MARK = regex.compile(r"^\s*(```|~~~)[\w+-]*\s*$", regex.M)
_MARKS = regex.compile(r"[^\p{L}\p{N}]+")


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    bare = _MARKS.sub(" ", _FENCE_MARK.sub(" ", _TAG.sub(" ", answer))).strip().lower()
    return not bare or bare in PLACEHOLDERS


# ---- copy --------------------------------------------------------------------------------------
_TOKEN = regex.compile(r"[\p{L}\p{N}]++(?:[-_][\p{L}\p{N}]++)++|\p{Han}|[\p{Hiragana}\p{Katakana}]+|[\p{L}\p{N}\p{M}]+")  # a name with hyphens is one word
# Words that frame a repeated question.
FRAME = set("q a question answer user assistant you asked ask your was is frage antwort pregunta respuesta pergunta resposta réponse вопрос ответ 问 答 问题 回答".split())


def tile(answer: list[str], question: list[str], least: int = 2) -> tuple[int, int]:
    """Greedy string tiling: tokens of the answer and of the question covered by common tiles.

    The question may be used again for what it left of the answer, but then in long tiles only: an
    answer that gives it back twice is covered, one that goes on in the question's words isn't.
    """
    places: dict[tuple[str, ...], list[int]] = {}
    least = min(least, len(question), len(answer)) or 1
    for j in range(len(question) - least + 1):
        places.setdefault(tuple(question[j : j + least]), []).append(j)
    taken_a, used_q = [False] * len(answer), [False] * len(question)
    while True:
        taken_q, any_tile = [False] * len(question), False
        shortest = least if not any(used_q) else max(least, (3 * len(question) + 4) // 5)
        while True:
            best, tiles = shortest - 1, []
            seen: dict[int, int] = {}  # how far each diagonal is known: what begins inside a match is its end
            for i in range(len(answer) - least + 1):
                if taken_a[i]:
                    continue
                for j in places.get(tuple(answer[i : i + least]), ()):
                    if i < seen.get(j - i, 0):
                        continue
                    n = 0
                    while i + n < len(answer) and j + n < len(question) and answer[i + n] == question[j + n] and not taken_a[i + n] and not taken_q[j + n]:
                        n += 1
                    seen[j - i] = i + n
                    if n > best:
                        best, tiles = n, [(i, j)]
                    elif n == best and n >= shortest:
                        tiles.append((i, j))
            if best < shortest:
                break
            for i, j in tiles:
                if not any(taken_a[i : i + best]) and not any(taken_q[j : j + best]):
                    taken_a[i : i + best] = [True] * best
                    taken_q[j : j + best] = [True] * best
                    used_q[j : j + best] = [True] * best
                    any_tile = True
        if not any_tile:
            return sum(taken_a), sum(used_q)


@lru_cache(1)
def _combining() -> dict[int, None]:
    return {c: None for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))}


def _plain(text: str) -> str:
    """Lower case without accents and raised figures: a slightly changed question is the same."""
    low = text.lower()
    return low if low.isascii() else unicodedata.normalize("NFKD", low).translate(_combining())


def is_copy(question: str | None, answer: str) -> bool:
    if not question:
        return False
    q, a = _TOKEN.findall(_plain(question)), _TOKEN.findall(_plain(answer))
    known = set(q)
    core = [x for x in a if x not in FRAME or x in known]
    if len(q) < 3 or len(core) < 0.7 * len(q):
        return False
    if sum(x in known for x in core) < 0.75 * len(core):
        return False
    covered, used = tile(core, q)
    return covered >= 0.85 * len(core) and used >= 0.75 * len(q)


# ---- refusal -----------------------------------------------------------------------------------
_END = regex.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|(?<=[。！？])[”’」』）]*|\n+|\s+–\s+(?=\p{Lu})")
# The parts a declining sentence is made of, by language.
_CAN_NOT = {
    "en": r"(?:\b(?:can|could|may|must|do|does|will|would|shall|am|are|is)(?:n['’]t|['’]t| not\b)|\bcannot\b|\bwon['’]t\b|\bunable to\b|\bnot (?:able|allowed|permitted|in a position|something I)\b|\brather not\b|\bprefer not\b|\bmust (?:decline|refuse)\b|\b(?:have|need) to (?:pass|decline|refuse)\b|\bI (?:decline|refuse)\b|\bno (?:answer|reply|comment)\b.*\b(?:by|from) me\b|\b(?:falls?|is|lies) outside\b|\bbeyond (?:what|my)\b|\bdo not permit\b|\bnot permit\b|\bagainst my\b)",
    "de": r"(?:\bkann (?:ich|dazu|dir|Ihnen)?.{0,40}\bnicht\b|\bdarf (?:ich)?.{0,30}\b(?:nicht|keine?)\b|\bmöchte (?:ich)?.{0,30}\bnicht\b|\bnicht (?:äußern|helfen|beantworten|sagen|behandeln)\b|\bkeine (?:Auskunft|Antwort|Angaben)\b|\blehne .{0,30}\bab\b|\bmuss (?:ich)? .{0,30}(?:ablehnen|passen)\b)",
    "fr": r"(?:\bne (?:peux|puis|souhaite|veux|suis|saurais|préfère)\b|\bne pas me prononcer\b|\bpréfère ne pas\b|\bdépasse ce (?:dont|que)\b|\bn['’]ai pas le droit\b|\bne m['’]est pas (?:permis|possible)\b|\bdois (?:refuser|décliner)\b|\bimpossible de (?:vous )?répondre\b)",
    "es": r"(?:\bno (?:puedo|debo|me es posible|me está permitido|estoy autorizad\w*|voy a|quiero|deseo|tengo permitido)\b|\bprefiero no\b|\bqueda fuera de\b|\bdebo (?:declinar|rechazar)\b|\bfuera de lo que\b)",
    "pt": r"(?:\bnão (?:posso|devo|me é (?:possível|permitido)|estou autorizad\w*|vou|quero|consigo|tenho permissão)\b|\bprefiro não\b|\bfora do que\b|\bdevo recusar\b|\bultrapassa o que\b)",
    "ru": r"(?:\bне (?:могу|вправе|буду|имею права|хочу|стану)\b|\bвынужден\w* отказать\w*|\bпредпочту не\b|\bвыходит за (?:рамки|пределы)\b)",
    "ja": r"(?:できません|でき(?:かね|ない)|(?:いた)?しかねます|お断り|控えさせて|差し控え)",
    "zh": r"(?:无法(?:回答|提供|讨论|帮助|协助|就)|不能(?:回答|提供|讨论|帮助|协助|就|谈)|不便|不予|恕(?:我|难)|超出了?我|拒绝回答|不愿(?:评论|讨论|回答)|不可以(?:回答|讨论)|没有权限)",
}
_SPEECH = {
    "en": r"(?:\b(?:help|assist|answer\w*|reply|respond|discuss\w*|comment\w*|talk\w*|details?|provid\w+|speak|share|say|go into|pass on|address|cover|give|do that|do this|information|opinion|request)\b)",
    "de": r"(?:\b(?:helfen|Auskunft|äußern|antworten|beantworten|Antwort|sagen|sprechen|Thema|dazu|Frage|Angaben)\b)",
    "fr": r"(?:\b(?:répondre|aider|parler|prononcer|question|sujet|réponse|discuter|commenter)\b)",
    "es": r"(?:\b(?:ayudar\w*|responder\w*|contestar|hablar|comentar|opinar|tema|pregunta|eso|respuesta|pronunciarme)\b)",
    "pt": r"(?:\b(?:ajudar|responder|falar|comentar|opinar|tema|questão|pergunta|isso|resposta|assunto)\b)",
    "ru": r"(?:\b(?:ответить|отвечать|помочь|обсуждать|говорить|вопрос\w*|тему|комментировать|ответ)\b)",
    "ja": r"(?:答え|回答|質問|手伝い|話し|説明|提供|対応|意見|コメント)",
    "zh": r"(?:回答|问题|讨论|意见|谈论|请求|帮|协助|提供|评论|话题|内容)",
}
#: Polite words around a refusal: they answer nothing.
_POLITE = regex.compile(
    r"^(?:hmm+|well|ok(?:ay)?|good (?:point|question)|great question|(?:it|that|this) is an? (?:interesting|good|great|important|fair|difficult)\b.*|i appreciate\b.*|(?:i['’]m |i am |so |very )?sorry|(?:my )?apologies|unfortunately|i (?:see|understand) why you.*|i (?:hope|trust) you understand.*|(?:thank you|thanks)\b.*|let me know\b.*|please\b.*|you (?:could|can|may|might)\b.*|is there anything else.*|feel free\b.*|"
    r"danke\b.*|vielen dank\b.*|leider|es tut mir leid|bitte\b.*|ich (?:hoffe auf|bitte um)\b.*|gute frage.*|merci\b.*|(?:je suis )?désolée?|malheureusement|bonne question.*|veuillez\b.*|n['’]hésitez\b.*|gracias\b.*|lo siento|lamentablemente|buena pregunta.*|por favor\b.*|(?:muito )?obrigad[oa]\b.*|lamento|infelizmente|boa (?:pergunta|questão).*|agradeço\b.*|"
    r"спасибо\b.*|извините|к сожалению|обратитесь\b.*|пожалуйста\b.*|хороший вопрос.*|благодарю\b.*|надеюсь\b.*|(?:感谢|谢谢|多谢).*|抱歉|对不起|很?遗憾|还?请.*|这是个?好问题|好问题|望.{0,2}谅解|敬请.*|申し訳(?:ありません|ございません).*|すみません.*|ごめんなさい.*|ご了承.*)[\s.!?,;:…–—-]*[。！？，]?$",
    regex.I,
)
#: What follows is the answer after all.
_TURN = regex.compile(r"\bbut\b(?!.{0,12}\bI (?:can|could|may|am|must|have)(?:['’]t|not| not| to)\b).{25,}|:\s*\S.{15,}|：.{8,}|\b(?:aber|mais|pero|mas|но|doch|however)\b.{0,3}(?:so viel|sí consta|voici|this much|так|eis)\b|不过.{8,}|但是?.{12,}", regex.I)


@lru_cache(1)
def _declines() -> list[tuple[regex.Pattern, regex.Pattern]]:
    return [(regex.compile(_CAN_NOT[k], regex.I), regex.compile(_SPEECH[k], regex.I)) for k in _CAN_NOT]


_SELF = regex.compile(r"\b(?:I|me|my|I'm|I'd|ich|mir|mich|je|j|me|mes|yo|mi|mis|eu|me|meu|minhas?|я|мне|мой|мои|меня|this (?:request|question|topic)|ce sujet|cette question|este tema|dazu|darf|puedo|prefiero|prefiro|debo|devo|posso|могу|вправе|lamento|siento|préfère)\b|我|该问题|这个(?:请求|问题)|恕|本人|[おご](?:答え|回答|質問|手伝い)|この(?:質問|件|話題)|その(?:質問|件)|私|当方", regex.I)


def declines(sentence: str) -> bool:
    """Whether a sentence declines to speak: who can't, that they can't, and what it is about."""
    if not _SELF.search(sentence) or _TURN.search(sentence):
        return False
    return any(no.search(sentence) and about.search(sentence) for no, about in _declines())


def is_refusal(answer: str) -> bool:
    """An answer is a refusal if a sentence declines and all others are polite words."""
    found = False
    for sentence in filter(None, (x.strip(" \t>*_-#") for x in _END.split(answer))):
        if declines(sentence):
            found = True
        elif not _POLITE.match(sentence):
            return False
    return found


# ---- language ----------------------------------------------------------------------------------
# Frequent function words, and letters that tell a language.
WORDS = {
    "en": "the of and to is are was be been in on for with that this it its than which when where how why what does do not by from as at or an each every whenever before after between both has have we you should would only keeps against without under over into them then".split(),
    "de": "der die das den dem des und ist sind war wird werden ein eine einer eines einem einen nicht von zu zur zum mit auf für im in als auch wenn dass damit wann wie warum was welche welcher nach bei über aus laut sich wodurch weshalb mehr hält sobald zunächst vor ohne".split(),
    "fr": "le la les des du de un une et est sont qui que quoi dans pour par sur avec pas ne plus ce cette ces se s’est au aux en comme quand pourquoi comment si bien dont après chaque même quel quelle d’après nous avons faut il elle l’on voici".split(),
    "es": "el la los las un una unos unas y es son que en de del al por para con no más se lo como cuando cuándo cómo qué según hay este esta cada sobre también después así tarda porque dónde sigue han sin".split(),
    "pt": "o a os as um uma uns umas e é são que em de do da dos das no na nos nas por para com não mais se como quando porque segundo este esta cada sobre também após ao aos à às pelo pela já foi deu onde até sem".split(),
}
_OWN = {w: [k for k in WORDS if w in WORDS[k]] for k in WORDS for w in WORDS[k]}
LETTERS = {"de": "äöüß", "fr": "èêëîïûùœæ", "es": "ñ¿¡", "pt": "ãõ"}
_NAMES = regex.compile(r"```.*?(?:```|$)|`[^`\n]*`|《[^》]*》|“[^”]{0,40}”|「[^」]*」|\b\w{1,6}\([^()\n]{0,40}\)|https?://\S+|(?<![\p{Latin}\d_.-])[\p{Latin}.-]*+[_\d][\p{Latin}\d_.-]*", regex.S)
_WORD = regex.compile(r"[\p{Latin}\p{M}’']+")
_HAN, _CYRILLIC, _LATIN = regex.compile(r"\p{Han}"), regex.compile(r"\p{Cyrillic}"), regex.compile(r"\p{Latin}")
# Names of languages, in the languages themselves.
ASKED = {
    "en": r"\benglish\b|\benglisch|\banglais|\binglés\b|\binglês\b|английск|英语|英文",
    "de": r"\bgerman\b|\bdeutsch|\ballemand|\balemán\b|\balemão\b|немецк|德语|德文",
    "fr": r"\bfrench\b|\bfranzösisch|\bfrançais|\bfrancés\b|\bfrancês\b|французск|法语|法文",
    "es": r"\bspanish\b|\bspanisch|\bespagnol|\bespañol\b|\bespanhol\b|\bcastellano\b|испанск|西班牙",
    "pt": r"\bportuguese\b|\bportugiesisch|\bportugais|\bportugués\b|\bportuguês\b|португальск|葡萄牙",
    "ru": r"\brussian\b|\brussisch|\brusse\b|\bruso\b|\brusso\b|русск|俄语|俄文",
    "zh": r"\bchinese\b|\bmandarin|\bchinesisch|\bchinois|\bchino\b|\bchinês\b|китайск|中文|汉语|华语",
}
_ASKED = {k: regex.compile(v, regex.I) for k, v in ASKED.items()}


@lru_cache(4096)
def language(text: str) -> str | None:
    """The language of a text, if it shows; names, numbers, code and quotations show none."""
    bare = _NAMES.sub(" ", text)
    han, cyrillic, latin = (len(p.findall(bare)) for p in (_HAN, _CYRILLIC, _LATIN))
    if max(han * 2, cyrillic, latin) < 4:
        return None
    if han * 2 >= max(cyrillic, latin):
        return "zh"
    if cyrillic >= latin:
        return "ru"
    score = dict.fromkeys(WORDS, 0.0)
    words = _WORD.findall(bare.lower().replace("'", "’"))
    for w in words:
        for part in {w, *w.split("’")}:
            for k in _OWN.get(part, ()):
                score[k] += 1.0 / len(_OWN[part])
    low = bare.lower()
    for k, letters in LETTERS.items():
        score[k] += 1.0 * sum(low.count(c) for c in letters)
    first, second = sorted(score.values(), reverse=True)[:2]
    if first < 1.0 or first - second < 0.5:
        return None
    return max(score, key=score.get)


def is_wrong_language(question: str | None, answer: str) -> bool:
    if not question or (q := language(question)) is None or (a := language(answer)) is None or q == a:
        return False
    if len(_WORD.findall(answer)) + len(_CYRILLIC.findall(answer)) // 4 + len(_HAN.findall(answer)) // 2 < 4:
        return False
    return not _ASKED[a].search(question)


# ---- truncated ---------------------------------------------------------------------------------
_CLOSES = {")": "(", "]": "[", "}": "{", "）": "（", "】": "【", "》": "《", "」": "「", "』": "『", "»": "«", "”": "“"}
_ITEM = regex.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)]|[a-z][.)])\s*(.*)$")
_STOPS = regex.compile(r"[.!?。！？][\"'”’»)）」』\]*_`]*$")
_TAILS = regex.compile(r"(?:\.\.\.|…|[,;:，；：、(（\[{“«‘„\-–—/=+&|<*])$")
_BREAK = regex.compile(r"[.!?。！？](?:\s|$)|[。！？]")


# Elements that have no end, and those whose end may be left out.
_VOID = set("br hr img input meta link wbr col area base embed source track".split())
_OPTIONAL_END = set("p li tr td th dt dd thead tbody tfoot option".split())
_ELEMENTS = set("table ul ol dl div span b i u em strong code pre a h1 h2 h3 h4 h5 h6 blockquote details summary sub sup kbd".split()) | _OPTIONAL_END
_MARKUP = regex.compile(r"<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?(?P<own>/?)>|(?P<code>`+)|(?P<strong>\*\*|__)|(?P<mark>[()\[\]{}（）【】《》「」『』«»“”„\"])")


def _pop(stack: list[str], name: str) -> None:
    if name in stack:
        while stack.pop() != name:
            pass


def open_ends(text: str) -> list[str]:
    """What a pushdown parser has on its stack at the end of the text: all that was opened and not closed.

    Its symbols are fences, code marks, elements of markup, brackets, quotation marks and emphasis.
    Between fences and code marks nothing else counts. A straight quotation mark opens after white
    space or a bracket and closes after anything else; so does emphasis. Elements whose end may be
    left out don't count at the end.
    """
    stack: list[str] = []
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith(("```", "~~~")):
            if stack and stack[-1] == bare[:3]:
                stack.pop()
            elif not stack or stack[-1] not in ("```", "~~~"):
                stack.append(bare[:3])
            continue
        if "```" in stack or "~~~" in stack:
            continue
        code = None
        for m in _MARKUP.finditer(line):
            kind, c = m.lastgroup, m.group()
            if m["code"]:
                code = None if code else "`"
                continue
            if code:
                continue
            before, after = line[m.start() - 1 : m.start()], line[m.end() : m.end() + 1]
            if m["name"]:
                name = m["name"].lower()
                if name in _ELEMENTS and not m["own"]:
                    if m["end"]:
                        _pop(stack, f"<{name}>")
                    else:
                        stack.append(f"<{name}>")
            elif kind == "strong" or c == '"':
                if c in stack and before.strip():
                    _pop(stack, c)
                elif c not in stack and (not before or before in " \t([{（“„>—–-|*_") and after.strip() and (c == '"' or after not in "*_"):
                    stack.append(c)
            elif c in "([{（【《「『«“„":
                stack.append(c)
            elif stack:
                if stack[-1] == _CLOSES[c] or (c in "”“" and stack[-1] in "„“"):
                    stack.pop()
                elif c in ")]}）":
                    _pop(stack, _CLOSES[c])
            if c == "“" and len(stack) > 1 and stack[-2] == "„" and stack[-1] == "“":
                del stack[-2:]  # the German closing mark is the English opening one
        if code:
            stack.append(code)
    return [x for x in stack if x[1:-1] not in _OPTIONAL_END]


def is_truncated(answer: str) -> bool:
    text = answer.rstrip()
    lines = text.split("\n")
    last = lines[-1].strip()
    ends = open_ends(text)
    if ends:
        return True
    if last.startswith(("```", "~~~")):
        return False
    if (m := _ITEM.match(lines[-1])) and (len(lines) > 1 or last[0] not in "-*+•"):
        body = m.group(1).strip()
        if not body:
            return True
        if not _STOPS.search(body):
            others = [o.group(1).strip() for x in lines[:-1] if (o := _ITEM.match(x))]
            if len(lines) > 1:
                return bool(_TAILS.search(body)) or bool(others) and all(_STOPS.search(o) for o in others)
    if last.startswith("|"):
        return not last.endswith("|")
    if text.endswith(("...", "…")):
        return True
    if _STOPS.search(last):
        return False
    if last.startswith("#") or regex.fullmatch(r"(?:[-*_=]\s?){3,}", last):
        return False
    if last[-1] in ")）]】》」』”»\"'`*_~":
        return False
    if _TAILS.search(last):
        return True
    tokens = _TOKEN.findall(last)
    han = sum(bool(_HAN.match(t)) for t in tokens)
    if _BREAK.search(text) or len(lines) > 1 and not han and len(tokens) > 4:
        return True
    if han:
        return han > 8 or "，" in last or "," in last
    words = [w for w in _WORD.findall(last.lower().replace("'", "’"))]
    if words and len(tokens) > 2 and words[-1] in _OWN:
        return True
    return len(tokens) > 4 or len(words) > 3 and last[0].isupper()


def defect(question: str | None, answer: str | None) -> str | None:
    """The defect of a pair, None for a sound one. The texts are in their consistent form."""
    if is_empty(answer):
        return "empty"
    if is_copy(question, answer):
        return "copy"
    if is_refusal(answer):
        return "refusal"
    if is_wrong_language(question, answer):
        return "wrong_language"
    return "truncated" if is_truncated(answer) else None


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches, "answer"):
        questions, answers = unify_array(batch.column(1)).to_pylist(), unify_array(batch.column(2)).to_pylist()
        found = [defect(q, a) for q, a in zip(questions, answers, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["pair_key", "defect"])


def defects(df: DataFrame, key: str, question: str, answer: str) -> DataFrame:
    """(pair_key, defect): every pair once, with null for a sound one.

    A null answer is ``empty``; a null question can't be copied and has no language. Rows that
    repeat key and texts are one pair; a key with several answers gives a row for each. A null key is
    a key. Texts of any length are read whole; other columns have no effect.
    """
    rows = df.select(F.col(key).cast("string").alias("pair_key"), F.col(question).alias("question"), F.col(answer).alias("answer"))
    rows = rows.withColumn("h", F.md5(F.to_json(F.struct("question", "answer")))).dropDuplicates(["pair_key", "h"]).drop("h")
    return rows.mapInArrow(_judge, "pair_key string, defect string")
