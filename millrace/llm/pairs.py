"""Problem 5: broken prompt and response pairs, with the kind of defect."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.words import chunks
from .languages import fit_languages, other_language, prose

_WORD = re.compile(r"[^\W_]+")
#: Characters of scripts without spaces between words are words of their own where copies are sought.
_UNSPACED = "\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\u0e00-\u0e7f\u0e80-\u0eff\u1000-\u109f\u1780-\u17ff\U00020000-\U0003ffff"
_UNIT = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
_CHARACTER = re.compile(f"[{_UNSPACED}]")
_TERMINAL = ".。!?！？"
_CLOSERS = "\"'”’»)]}*$` \t\n\r）】」"

#: Closing words that may follow the answer.
CLOSINGS = ("works", "as wanted", "as required", "as desired", "as claimed", "checked by substitution", "is the answer", "q.e.d", "qed")

#: Words of placeholders and headings that say nothing by themselves.
EMPTY_WORDS = frozenset(
    """null none nil nan na tbd tba todo pending missing empty placeholder boxed text answer answers solution solutions final proof response result
    respuesta solución solucion réponse reponse démonstration lösung loesung antwort beweis ergebnis 答案 解 解答 答 解析 证明 无""".split()
)
#: Answers that decline.
REFUSAL_ANSWERS = frozenset(["declined", "unable to answer", "i can't say", "i cannot say", "no answer will be given", "refused", "i decline", "cannot answer", "can't answer"])

EN_ACTS = "give provide produce supply offer deliver present write share answer solve prove help assist complete respond address discuss comply work proceed continue"
EN_OBJECTS = "answer answers solution solutions proof question problem request task exercise reply response this that"

_ASKED = "request task question problem exercise"
#: Refusals as words in order. A word of a slot stands for the slot. With each: the share of the slots that must align, how many
#: other words may stand before the next slot, and the number of a slot that must be among those aligned.
REFUSAL_WORDINGS = [
    (least, gap, anchor, tuple(frozenset(x.split()) for x in slots))
    for least, gap, anchor, *slots in (
        (1.0, 4, 2, "i we", "am are m re", "unable", "this that your the", _ASKED),
        (1.0, 0, 1, "i we", "cannot wont", "help assist answer solve complete comply"),
        (1.0, 1, 1, "i we", "cannot wont", "provide", "a the any", "solution answer"),
        (1.0, 0, 1, "i we", "cannot wont", "work continue do", "on through with this"),
        (0.8, 1, 2, "i we", "would d", "rather", "not", "answer solve help say do work"),
        (0.8, 1, 5, "i we", "do", "not", "have", "the", "means", "to"),
        (1.0, 1, 2, "i we", "must have need", "decline refuse"),
        (1.0, 1, 2, "i we", "must have need", "pass", "on", "this that the"),
        (1.0, 0, 2, "this that", "is", "something", "i we", "wont cannot"),
        (0.8, 1, 3, "answering solving this that it", "would", "go", "beyond", "what", "i we", "may"),
        (1.0, 0, 4, "no", "solution answer", "will", "be", "provided given"),
        (1.0, 0, 1, "i we", "decline refuse", "to", "answer solve help produce provide work"),
        (1.0, 1, 2, "je", "ne", "peux puis", "pas", "traiter répondre résoudre aider"),
        (1.0, 0, 1, "je", "refuse", "de", "répondre résoudre traiter"), (1.0, 0, 2, "je", "dois", "décliner refuser"),
        (1.0, 0, 1, "no", "puedo", "atender responder resolver ayudar ayudarle tramitar"), (1.0, 0, 1, "debo", "declinar rechazar"), (1.0, 0, 1, "me", "niego", "a", "responder resolver"),
        (1.0, 4, 2, "ich", "kann", "nicht", "bearbeiten beantworten lösen helfen erfüllen"), (1.0, 4, 2, "ich", "muss möchte", "ablehnen"),
        (1.0, 0, 2, "я", "не", "могу буду стану"), (1.0, 0, 2, "не", "могу", "помочь решить ответить выполнить"), (1.0, 0, 0, "вынужден вынуждена", "отказать отказаться"),
        (1.0, 2, 1, "δεν", "μπορώ", "να", "απαντήσω λύσω βοηθήσω δώσω"), (1.0, 0, 0, "αρνούμαι", "να"),
        (1.0, 0, 1, "لا", "يمكنني أستطيع استطيع", "الإجابة الاجابة حل المساعدة مساعدتك تقديم"), (1.0, 0, 0, "أرفض", "الإجابة حل"),
        (1.0, 0, 1, "איני אינני לא", "יכול יכולה", "לענות לפתור לעזור לספק"), (1.0, 0, 1, "אני", "מסרב מסרבת", "לענות לפתור"),
    )
]
#: The same for scripts that don't part words by spaces, or whose words hold marks: with each slot, how many other characters may stand
#: before it. An empty string is the end of the sentence.
REFUSAL_SIGNS_IN_ORDER = [
    tuple((gap, tuple(x.split(" "))) for gap, x in slots)
    for slots in (
        ((0, "无法 不能 不便 拒绝"), (0, "处理 回答 解答 提供 完成 帮助 协助 满足"), (12, "请求 问题 题目 要求 解答 任务 此题 您 你 本题 ")),
        ((0, "答え 回答 解答 手伝い 提供 対応 協力"), (8, "できません できない 出来ません 出来ない かねます お断り 拒否")),
        ((0, "お断りし お断りい お断り致"),),
        ((0, "답변 대답 풀이 해결 도움 도와 제공 응답"), (10, "수^없습니다 수^없어요 거절 거부")),
        ((0, "उत्तर हल मदद सहायता जवाब"), (12, "नहीं^दे नहीं^कर"), (1, "सकता सकती सकते")),
        ((0, "ไม่สามารถ"), (0, "ตอบ แก้ ช่วย ให้คำตอบ")), ((0, "ขอปฏิเสธ"),),
    )
]

#: Refusals as words in order: who, that they can't or won't, what they would do, and with what. A word of a slot stands for the
#: slot. Where nobody need be named there is no first slot. With each, the share of the slots that must align.
REFUSAL_SLOTS = [
    (tuple(frozenset(x.split()) for x in slots), least)
    for least, *slots in (
        (0.75, "i", "cannot unable wont refuse decline", EN_ACTS, EN_OBJECTS),
        (1.0, "i", "cannot unable wont refuse decline", "craft create construct derive compute find determine generate formulate show finish say tell explain return output", EN_OBJECTS),
        (1.0, "we", "cannot unable wont refuse decline", EN_ACTS, EN_OBJECTS),
        (1.0, "puedo podemos capaz incapaz niego rehúso", "dar ofrecer responder contestar resolver ayudar proporcionar producir presentar escribir", "respuesta solución demostración problema pregunta ejercicio solicitud tarea esto"),
        (0.75, "je", "peux puis incapable refuse", "donner fournir répondre résoudre aider produire proposer présenter rédiger traiter", "réponse solution démonstration problème question exercice demande tâche cela"),
        (0.75, "ich", "nicht keine keinen weigere", "geben liefern beantworten lösen helfen angeben erstellen bieten bearbeiten", "antwort lösung beweis aufgabe frage anfrage problem"),
        (1.0, "ich", "nicht keine keinen", "antwort lösung beweis hilfe", "geben liefern angeben erstellen bieten vorlegen nennen"),
        (1.0, "posso possiamo grado rifiuto", "dare fornire rispondere risolvere aiutare aiutarti aiutarla produrre offrire presentare", "risposta soluzione dimostrazione problema domanda esercizio richiesta compito questo"),
        (1.0, "posso podemos consigo capaz incapaz recuso", "dar fornecer responder resolver ajudar ajudá produzir oferecer apresentar", "resposta solução demonstração problema pergunta questão exercício pedido tarefa isso lo"),
        (1.0, "могу можем буду стану отказываюсь", "дать предоставить ответить решить помочь привести выполнить", "ответ решение доказательство задачу задачей вопрос запрос это"),
    )
]
_NEGATED = frozenset("no non não nao не incapaz niego rehúso rifiuto recuso отказываюсь ne nicht keine keinen weigere incapable refuse cannot unable wont decline".split())
_UNABLE = [(re.compile(p), to) for p, to in ((r"\bcan't\b|\bcan not\b|\bcould not\b|\bcouldn't\b", "cannot"), (r"\bwon't\b|\bwill not\b", "wont"), (r"\bnot able\b", "unable"))]
_ARTICLES = frozenset(("a", "an", "the", "any", "our", "my", "your"))  # the next word is no act
_SENTENCE = re.compile(r"[.!?。！？\n]+")


def _screen() -> tuple[str, ...]:
    """Strings one of which every text that aligns with a refusal holds: a word of an anchor, or of the slot that says can't or won't, or a first sign."""
    out = {w for _, _, anchor, slots in REFUSAL_WORDINGS for w in slots[anchor]} | {w for slots, _ in REFUSAL_SLOTS for w in slots[len(slots) - 3]}
    out |= {w for slots in REFUSAL_SIGNS_IN_ORDER for w in slots[0][1]}
    out |= {"can't", "can not", "could not", "couldn't", "won't", "will not", "not able"}  # what becomes cannot, wont and unable
    return tuple(sorted(w for w in out if not any(o in w for o in out - {w})))


_REFUSAL_SIGNS = _screen()


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def units(text: str) -> list[str]:
    """Words, but single characters of scripts that don't part words by spaces."""
    return words(text) if text.isascii() else _UNIT.findall(text.lower())


def is_empty(text: str | None) -> bool:
    """Null, blank, without letters and digits, or nothing but placeholders and headings."""
    if text is None:
        return True
    own = words(re.sub(r"\bn\s*/\s*a\b|\\[a-z]+(?=\{\s*\})", " na ", text.lower()))
    return all(w in EMPTY_WORDS for w in own)


def aligned_share(slots: tuple[frozenset[str], ...], sentence: list[str]) -> float:
    """Share of the slots in a common subsequence with some stretch of a sentence that is not much longer.

    All slots but the last must align, those up to the one that says can't or won't (the last but two) near each other.
    """
    fixed = len(slots) - 2
    best = 0
    for k, w in enumerate(sentence):
        if w not in slots[fixed - 1] or not _NEGATED.intersection(sentence[max(0, k - 3) : k + 1]) or fixed > 1 and not slots[0].intersection(sentence[max(0, k - 4) : k]):
            continue
        after = ["act" if x in slots[-2] and before not in _ARTICLES else "object" if x in slots[-1] else "" for before, x in zip(sentence[k : k + 9], sentence[k + 1 : k + 10])]
        if "act" in after:
            best = max(best, fixed + common_subsequence(["act", "object"], after))
    return best / len(slots)


def aligned_slots(slots: tuple[frozenset[str], ...], sentence: list[str], gap: int, anchor: int) -> float:
    """Largest share of the slots that align in order with words of a sentence, the anchor among them, with at most ``gap`` other words between two of them."""
    top = 0
    reached: list[list[tuple[int, int]]] = [[] for _ in sentence]  # (slot, aligned with the anchor counted as 100)
    for k, w in enumerate(sentence):
        for i, slot in enumerate(slots):
            if w in slot:
                before = max((n for back in range(1, gap + 2) if k >= back for j, n in reached[k - back] if j < i), default=0)
                n = before + 1 + (100 if i == anchor else 0)
                reached[k].append((i, n))
                if n > 100:
                    top = max(top, n - 100)
    return top / len(slots)


def aligned_signs(slots: tuple[tuple[int, tuple[str, ...]], ...], sentence: str, at: int | None = None) -> bool:
    """Whether strings of all slots stand in a sentence in order, each near enough to the one before."""
    if not slots:
        return True
    (gap, signs), rest = slots[0], slots[1:]
    for sign in signs:
        sign = sign.replace("^", " ")
        if not sign:
            if len(sentence) - (at or 0) <= gap:
                return True
            continue
        k = sentence.find(sign, at or 0)
        while k >= 0 and (at is None or k - at <= gap):
            if aligned_signs(rest, sentence, k + len(sign)):
                return True
            k = sentence.find(sign, k + 1)
    return False


def aligns_with_refusal(text: str) -> bool:
    """Whether a sentence of a lower-cased text aligns with a refusal: its words or signs in order, or who, can't, act and object."""
    for pattern, to in _UNABLE:
        text = pattern.sub(to, text)
    for sentence in _SENTENCE.split(prose(text)):
        own = words(sentence)
        if not own:
            continue
        held = set(own)
        if any(not held.isdisjoint(slots[anchor]) and aligned_slots(slots, own, gap, anchor) >= least - 1e-9 for least, gap, anchor, slots in REFUSAL_WORDINGS):
            return True
        if not _NEGATED.isdisjoint(held) and any(aligned_share(slots, own) >= least for slots, least in REFUSAL_SLOTS):
            return True
        if not sentence.isascii() and any(aligned_signs(slots, sentence) for slots in REFUSAL_SIGNS_IN_ORDER):
            return True
    return False


def is_refusal(solution: str, answer: str | None) -> bool:
    """A declining template aligns with the solution, or the answer declines."""
    text = solution.replace("’", "'").lower()
    return any(w in text for w in _REFUSAL_SIGNS) and aligns_with_refusal(text) or (answer or "").replace("’", "'").strip().rstrip(".").lower() in REFUSAL_ANSWERS


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits of an integer for ``a``."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        met = row & at.get(w, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def containment(part: list[str], whole: list[str], n: int = 3) -> float:
    """Share of the runs of ``n`` words of ``part`` that stand in ``whole``."""
    if len(part) < n:
        return 0.0
    held = {tuple(whole[i : i + n]) for i in range(len(whole) - n + 1)}
    runs = [tuple(part[i : i + n]) for i in range(len(part) - n + 1)]
    return sum(r in held for r in runs) / len(runs)


def is_copy(problem: str, solution: str) -> bool:
    """Whether a solution only restates its problem, by :func:`units`.

    It does if 0.75 of its runs of three units (four, if most are single characters) stand in the problem, or 0.75 of its
    units form a common subsequence with it (or 0.7, if half of the runs stand there). Without shared runs the
    subsequence must cover half of the problem too, as frequent words alone may align so far with a long one; for a
    solution of fewer than 6 units, 0.8 of it. Runs and the subsequence are only looked for where the units that both have,
    which bound them from above, are enough; so nothing is lost.
    """
    p, s = units(problem), units(solution)
    n = len(s)
    if n < 2:
        return False
    held = set(p)
    common = sum(w in held for w in s)
    size = 4 if 2 * len(_CHARACTER.findall(solution)) > n else 3
    inside = 0.0
    if n >= 6 and common >= 0.5 * (n - size + 1):
        inside = containment(s, p, size)
        if inside >= 0.75:
            return True
    if common < 0.7 * n:
        return False
    both = Counter(p) & Counter(s)
    if both.total() < 0.7 * n:
        return False
    aligned = common_subsequence(s, p)
    if n >= 6 and inside >= 0.5 and aligned >= 0.7 * n:
        return True
    return aligned >= 0.75 * n and aligned >= (0.5 if n >= 6 else 0.8) * len(p)


def is_balanced(text: str) -> bool:
    """Whether braces, brackets and dollar signs close."""
    depth = 0
    for c in text:
        if c in "{(":
            depth += 1
        elif c in "})":
            depth -= 1
            if depth < 0:
                return False
    return depth == 0 and text.count("$") % 2 == 0


def _squeezed(text: str) -> str:
    return re.sub(r"\s+|[.。$*]|\\[!,;]|\\?boxed", "", text)


def is_cut_answer(answer: str) -> bool:
    """An answer whose brackets stay open or that ends in a sign that needs something after it."""
    a = answer.strip()
    return not is_balanced(a) or bool(re.search(r"(?:[=+\-*/^_,<>\\(\[{:]|\\[A-Za-z]+|\.\.\.|…)$", re.sub(r"\\(?:pi|infty|alpha|beta|theta|emptyset|deg|circ|[)}\]])$", "x", a)))


def is_cut_solution(solution: str, answer: str) -> bool:
    """Breaks off inside a sentence or formula; a text that closes with its answer is complete without a full stop."""
    s = solution.rstrip()
    if s.endswith(("...", "…")):
        return True
    bare = s.rstrip(_CLOSERS)
    if bare and bare[-1] in _TERMINAL or s[-1] in _TERMINAL:
        return False
    low = s.lower().rstrip(") \t\n")
    closing = max((c for c in CLOSINGS if low.endswith(c)), key=len, default="")
    said = s[: len(low) - len(closing)].rstrip(" \t\n,(") if closing and len(low) == len(s.rstrip(") \t\n")) else s
    a, end = _squeezed(answer).rstrip("})"), _squeezed(said).rstrip("})")
    before = end[-len(a) - 1 : -len(a)] if a else ""
    return not (a and end.endswith(a) and not (before.isdigit() and a[0].isdigit()))


def defect(problem: str | None, solution: str | None, answer: str | None, other_language: bool = False) -> str | None:
    """The pair's defect, if any: a reply that declines or is empty first, then copies, other languages and cut texts.

    ``other_language`` is what :func:`languages.other_language` says of the pair.
    """
    if solution is not None and not is_empty(solution) and is_refusal(solution, answer):
        return "refusal"
    if is_empty(solution) or is_empty(answer):
        return "empty"
    if problem and is_copy(problem, solution):
        return "copy"
    if problem and other_language:
        return "language"
    if is_cut_answer(answer) or is_cut_solution(solution, answer):
        return "truncated"
    return None


def broken_pairs(pairs: DataFrame, labelled: DataFrame, labelled_rows: int = 4096) -> DataFrame:
    """``key, defect`` of each pair with a defect; rows without one are left out.

    ``pairs`` has ``key``, ``problem``, ``solution`` and ``answer``; ``labelled`` has ``text`` and ``lang``, from a
    bounded sample of which languages are learned (:func:`languages.fit_languages`). Other columns are ignored. Defects:

    - ``refusal``: a sentence of the solution aligns with a refusal, or the answer declines;
    - ``empty``: solution or answer is null, blank, or only placeholders and headings;
    - ``copy``: the solution's runs or a common subsequence with the problem cover it (see :func:`is_copy`; in Chinese,
      Japanese and other scripts without spaces characters count as words);
    - ``language``: most of the solution is in another language than the problem;
    - ``truncated``: solution or answer breaks off.

    A pair has the first that applies. A null problem can have all but ``copy`` and ``language``; without labelled
    texts languages of one script are not told apart. Repeated rows count once; null keys are left out; an empty
    table gives an empty result. Whole texts are read: the cost of a pair is linear in its length but for copies,
    which align word by word.
    """
    model = fit_languages(labelled, labelled_rows)
    shared = pairs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size for each language of the sample

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(4)]
            found = []
            for first, part in chunks([(p or "") + (s or "") for p, s in zip(columns[1], columns[2])]):
                keys, problems, solutions, answers = (c[first : first + len(part)] for c in columns)
                other = other_language(shared.value, [p or "" for p in problems], [s or "" for s in solutions])
                found += [(k, d) for k, p, s, a, o in zip(keys, problems, solutions, answers, other.tolist()) if (d := defect(p, s, a, o))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([d for _, d in found], pa.string())], names=["key", "defect"])

    rows = pairs.select(F.col("key").cast("string").alias("key"), "problem", "solution", "answer").where("key is not null")
    return rows.mapInArrow(find, "key string, defect string").distinct()
