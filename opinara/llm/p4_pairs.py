"""Broken prompt and response pairs: every defect of an answer, by ordered rules."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import canon
from opinara.llm import p3_language as lang

#: In the order in which they are looked for; a row's first one is its defect.
DEFECTS = ("empty", "copied", "refusal", "truncated", "other_language")
RULES = ("empty", "copied", "refusal", "no_map", "unclosed", "abrupt", "script", "language")

#: The most frequent closed-class words of five languages, without accents and in lower case.
FUNCTION_WORDS = {
    "en": "the of and to in is it that this was for with as on are be at have from or by not but what which there their they we you his her has had would could should only about into more some than then when where who will so no if out up i my me do does did been were them an a",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como mas pero sus le ya o este si porque esta entre cuando muy sin sobre tambien me hasta hay donde quien desde todo nos durante mi yo son fue ser ha he esto eso estas estos ni tan cual",
    "ca": "de la que el i a els es del les un per amb no una seu al ho com mes pero seus li ja o aquest si perque aquesta entre quan molt sense sobre tambe em fins hi ha on qui des tot ens durant en meu meva jo son va ser he aixo ni tan cap va vaig",
    "fr": "de la le et les des en un du une que est pour qui dans il par sur pas au plus ce ne se sont avec son aux d cette mais ou nous ses etre ont je vous comme fait y sans elle leur tout l n s qu mon ma me ni si a ete cela",
    "de": "der die und in den von zu das mit sich des auf fur ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem uber so zum war haben nur oder aber vor ich mir mein meine man wenn kein keine was ihr wir",
}
_CLOSED = {x: frozenset(ws.split()) for x, ws in FUNCTION_WORDS.items()}

#: How a refusal is put together: somebody speaking of themselves (ME, where the verb doesn't tell) denies being able,
#: willing or allowed (NOT_ABLE) to do something that is asked of an annotator (TASK); or refuses in so many words (REFUSE); or names a norm that stands against it (NORM);
#: or finds that it isn't fitting or permitted (UNFIT). Letters are lower case and without accents.
_GRAMMAR = {
    "en": {
        "ME": r"\b(?:i|we|i'm|i'll|i'd|we're)\b",
        "NOT_ABLE": r"(?:can(?:not|'t| not)|could(?: not|n't)|won't|will not|shall not|shan't|would(?: not|n't)|do(?: not|n't) (?:want|wish|intend|feel able|feel comfortable|think i (?:can|should))|(?:am|are|'m|'re) (?:not|un)[ -]?(?:able|willing|going|prepared|in a position|comfortable|equipped|supposed|qualified))",
        "TASK": r"(?:help|assist|rat(?:e|ing)|label|tag|annotat|analy[sz]|evaluat|assess|judg|giv|provid|do (?:this|that|it|so)|answer|compl[yi]|complete|process|respon|classif|fulfil|continu|perform|offer|produc|mak|engag|proceed|shar|support|extract|scor|grad|review|carry out|take part|discuss|comment)",
        "REFUSE": r"\b(?:i|we)\b(?:(?:'m| am| are)? (?:afraid|sorry|going)[^.!?]{0,30})? ?(?:'ll|'d| will| would| must| have to| need to| prefer to| am going to| rather| respectfully| politely| regretfully| therefore| would rather| (?:am|feel) (?:obliged|forced|bound) to| am afraid i (?:must|have to))* ?\b(?:declin\w*|refus\w*|abstain\w*|pass on (?:this|that)|opt out|rather not|prefer not|turn down)\b",
        "NORM": r"(?:against|violat\w+|contrary to|in conflict with|conflicts? with|outside|beyond|not (?:in line|consistent|compatible) with) (?:of )?(?:my|our) (?:own )?(?:guidelin|polic|rule|princip|instruct|standard|value|scope|abilit|programm|norm|safety)|(?:my|our) (?:guidelin\w+|polic\w+|rules?|princip\w+|instruct\w+|programming) (?:do(?:es)? not|don't|doesn't|forbid|prohibit|prevent|won't|rule out|bar)",
        "UNFIT": r"\b(?:not|n't|un|im)[ -]?(?:be )?(?:permitted|allowed|authori[sz]ed|appropriate|possible|ethical|proper|right|acceptable|suitable|my place|something i can|something i (?:am|'m) able)\b[^.!?]*\b(?:me|i|my|us|we|request|task)\b|\b(?:i|we)(?:'m| am| are| was|'re) (?:not|never) (?:permitted|allowed|authori[sz]ed|cleared|supposed|entitled)|(?:request|task|question) (?:can(?:not|'t)|could not|will not|won't) be (?:\w+ ){0,2}(?:fulfilled|processed|answered|completed|handled|done|carried)",
    },
    "es": {
        "ME": r"",
        "NOT_ABLE": r"\bno (?:me |te |le |lo |la |les |os )?(?:puedo|podre|podria|podemos|quiero|deseo|pienso|debo|deberia|voy a|vamos a|pretendo|soy capaz|estoy (?:en condiciones|en disposicion|capacitad|dispuest|preparad)|me (?:es|resulta|sera|seria) posible|me veo capaz|me siento comod)",
        "TASK": r"(?:ayud|asist|valor|etiquet|analiz|analis|evalu|juzg|dar|ofrec|proporcion|hac|respond|contest|complet|cumpl|proces|clasific|continu|segu|realiz|emit|puntu|calific|opin|coment|atend|llevar|extra|gener|colabor|particip)",
        "REFUSE": r"\b(?:me niego|me negare|rechazo|rehuso|declino|me abstengo|me abstendre|renuncio a|lamento no poder|siento no poder|prefiero no|preferiria no|opto por no)\b|\b(?:debo|tengo que|he de|prefiero|necesito|quisiera|voy a|me veo (?:obligad\w+|forzad\w+) a|habre de|tendre que) (?:\w+ )?(?:rechazar|declinar|negarme|abstenerme|rehusar|desestimar)|\bno (?:le |lo |la |te |os |les )?(?:har|dar|valorar|evaluar|puntuar|etiquetar|analizar|juzgar|opinar|responder|contestar|emitir|ofrecer|calificar|clasificar|ayudar|participar|continuar)e\b",
        "NORM": r"(?:en contra de|contrari\w+ a|contraviene|incumple|infringe|viola|fuera de|choca con) (?:mis|nuestras|nuestros) (?:norm|polit|regl|princip|directric|instruc|pautas|valor|capacid|funcion)|(?:mis|nuestras) (?:normas|politicas|reglas|directrices|instrucciones|pautas) (?:no|me (?:lo )?(?:impiden|prohiben)|lo prohiben|prohiben|impiden)",
        "UNFIT": r"\bno (?:me |nos )?(?:esta|estoy|estamos|es|seria|sera|resulta|resultaria|parece|tengo|se me|tenemos|cuento con) ?(?:me |nos |muy |el |la )?(?:permit|autoriz|habilit|posible|adecuad|correct|apropiad|etic|oportun|conveniente|procedente|permiso|legitim|aceptable)|\bme es imposible|\bme resulta imposible|\btengo prohibid|\bno se me permite|\bno puede (?:ser )?(?:atenderse|atendid|procesarse|procesad|completarse)",
    },
    "ca": {
        "ME": r"",
        "NOT_ABLE": r"\bno (?:et |us |li |ho |em |la |el )?(?:puc|podre|podria|podem|vull|desitjo|penso|dec|hauria de|vaig a|soc capac|estic (?:en condicions|en disposicio|capacitad|capacitat|dispos|preparad|preparat)|m'es possible|m['’]es possible|em sera possible|em veig capac|em sento comod)",
        "TASK": r"(?:ajud|assist|valor|etiquet|analitz|avalu|jutj|don|ofer|proporcion|fer|respon|contest|complet|compl|process|classific|continu|segu|realitz|emet|puntu|qualific|opin|coment|aten|dur|extre|gener|col·labor|collabor|particip)",
        "REFUSE": r"\b(?:em nego|em negare|rebutjo|refuso|declino|m'abstinc|m'abstindre|renuncio a|lamento no poder|em sap greu no poder|prefereixo no|preferiria no|m'estimo mes no|opto per no)\b|\b(?:he de|haig de|prefereixo|necessito|voldria|em veig (?:obligat|obligada|forcat) a|haure de) (?:\w+ )?(?:rebutjar|refusar|declinar|negar-me|abstenir-me)|\bno (?:en |ho |la |el |li |us |et )?(?:far|donar|valorar|avaluar|puntuar|etiquetar|analitzar|jutjar|opinar|respondr|contestar|emetr|oferir|qualificar|classificar|ajudar|participar|continuar)e\b|\ben fare cap\b",
        "NORM": r"(?:en contra de|contrari\w* a|contrave|incompleix|infringeix|viola|fora de|xoca amb) (?:les |els )?(?:meves|meus|nostres) (?:norm|polit|regl|princip|directri|instruc|paut|valor|capacit|funcion)|(?:les|els) (?:meves|meus|nostres) (?:normes|politiques|regles|directrius|instruccions|pautes|principis) (?:no|m'ho|ho prohibeixen|prohibeixen|impedeixen|m'impedeixen)",
        "UNFIT": r"\bno (?:em |ens |m')?(?:esta|estic|estem|es|seria|sera|resulta|sembla|tinc|se'm|tenim) ?(?:em |ens |gaire |el |la )?(?:perm|autoritz|habilit|possible|adequa|correct|apropia|etic|oportu|convenient|permis|legitim|acceptable)|\bm'es impossible|\bem resulta impossible|\btinc prohibit|\bno se'm permet|\bno es pot (?:atendre|processar|completar)",
    },
    "fr": {
        "ME": r"",
        "NOT_ABLE": r"\b(?:je|nous) (?:ne|n') ?(?:vous |le |la |l'|te |y )?(?:peux|pourrai|pourrais|puis|veux|voudrais|souhaite|desire|compte|dois|devrais|vais|pouvons|pourrons|saurais|suis (?:pas |guere )?(?:en mesure|capable|a meme|dispos|pret|a l'aise|qualifi|habilit))",
        "TASK": r"(?:aid|assist|evalu|etiquet|analys|not(?:er|e)\b|jug|donn|offr|fourni|propos|fai(?:re|s)|repond|complet|trait|class|continu|poursui|realis|emett|apprec|comment|donner suite|accept|extrai|gener|particip|prononc|satisf)",
        "REFUSE": r"\b(?:je|nous) (?:me |m'|nous )?(?:refus\w+|declin\w+|abst\w+|renonce\w*|prefere (?:ne pas|m'abstenir|refuser|decliner)|regrette de ne pas pouvoir)|\b(?:dois|vais devoir|prefere|suis (?:oblige|contraint|force|tenu)e? de?|me vois (?:oblige|contraint|force)e? de|me dois de|devrai) (?:\w+ )?(?:refuser|decliner|m'abstenir|renoncer)|\bje (?:ne |n')(?:vous |le |la |l')?(?:fer|donner|evaluer|noter|jug?er|analyser|etiqueter|repondr|commenter|fournir|classer|traiter|emettr|aider|participer|continuer)ai (?:pas|aucun|rien|point|guere)",
        "NORM": r"(?:contraire|oppos\w+) (?:a|aux) (?:mes|nos)|(?:a l'encontre|en dehors|hors) de (?:mes|nos) (?:regl|princip|directiv|consign|instruct|valeur|norm|politiq|capacit)|(?:contrevient|contrevien\w*|enfreint|viole) (?:a )?(?:mes|nos)|(?:mes|nos) (?:regles|principes|directives|consignes|instructions|normes) (?:ne |n'|m'interdi|interdi|m'empech|me l'interdi)",
        "UNFIT": r"\b(?:ne|n')(?: ?me| ?m'| ?nous)? ?(?:est|serait|sera|suis|sommes|semble|parait|ai|avons|m'est) (?:\w+ )?(?:pas |guere |plus )?(?:vraiment )?(?:le |la |l')?(?:permi|autoris|habilit|possible|appropri|correct|juste|convenable|ethique|opportun|acceptable|droit|permission|autorisation)|\bm'est (?:impossible|interdit|defendu)|\bil m'est interdit|\bne peut (?:pas )?etre (?:trait|satisf|accept)",
    },
    "de": {
        "ME": r"",
        "NOT_ABLE": r"(?:\bich\b[^.!?,;]{0,12}\b(?:kann|konnte|werde|darf|durfte|mochte|will|wurde|soll|mag)\b|\b(?:kann|konnte|werde|darf|durfte|mochte|will|wurde|soll|mag) ich\b)[^.!?]*\b(?:nicht|kein\w*|nie|niemals|leider nicht|weder)\b",
        "TASK": r"(?:helf|hilf|unterstutz|bewert|etikett|analys|beurteil|einschatz|schatz|einstuf|geb|abgeb|biet|liefer|mach|tun\b|antwort|beantwort|abschlie|erfull|bearbeit|verarbeit|klassifiz|fortsetz|fortfahr|durchfuhr|auswert|kommentier|leist|ausfuhr|erstell|erteil|urteil|weiter|nachkomm|vornehm|mitwirk|annotier|kennzeichn|einordn)",
        "REFUSE": r"\b(?:lehne|verweigere|weigere|enthalte)\b|\b(?:muss|mochte|will|werde|wurde|sollte) (?:ich )?[^.!?]*\b(?:ablehn|verweiger|absag|absehen|verzicht|enthalt|zuruckweis)\w*|\bich (?:verzichte|passe|sehe davon ab)\b|\blieber nicht\b",
        "NORM": r"(?:gegen|verletz\w+|verstoss\w+|verstie\w+|ausserhalb|widersprich\w*|widersprech\w*) (?:mein|unser)(?:e|en|er|em)? (?:\w+ )?(?:richtlini|regel|grundsatz|vorgab|prinzip|vorschrift|anweis|wert|moglichkeit|fahigkeit)|(?:meine|unsere) (?:richtlinien|regeln|grundsatze|vorgaben|prinzipien|vorschriften|anweisungen) (?:verbiet|erlaub|lass|untersag|gestatt|verhinder|hinder|schliess)",
        "UNFIT": r"\bnicht (?:\w+ )?(?:erlaubt|gestattet|moglich|befugt|berechtigt|autorisiert|in der lage|imstande|bereit|zulassig|angemessen|angebracht|richtig|vertretbar|ermachtigt)\b|\b(?:mir|uns) (?:\w+ )?(?:untersagt|verboten|unmoglich)\b|\bunmoglich (?:fur mich|mir)\b",
    },
}
_SENTENCE = re.compile(r"[.!?…]+(?=\s|$)|[\r\n]+")
#: What may stand between the denial and the task.
_BETWEEN = {
    "en": r"\w* ?(?:(?:be|to|simply|really|ethically|currently|honestly|safely|possibly|therefore|personally|in good conscience|with) )*",
    "es": r"\w* ?(?:(?:te|le|lo|la|les|os|a|en|de|con|ahora|aqui|poder|eticamente|lamentablemente|por desgracia|en este caso) )*",
    "ca": r"\w* ?(?:(?:et|us|li|ho|a|en|de|amb|ara|aqui|poder|eticament|malauradament|en aquest cas|us en|te'n) )*",
    "fr": r"\w* ?(?:(?:pas|plus|guere|malheureusement|vraiment|de|d'|a|vous|te|le|la|l'|y|en|ici|pouvoir) ?)*",
}
_ABLE = [(re.compile(g["ME"]), re.compile(g["NOT_ABLE"] + _BETWEEN[x] + r"\b" + g["TASK"])) for x, g in _GRAMMAR.items() if x in _BETWEEN]
#: In German the task may stand before, between or behind the parts of the denial.
_APART = [re.compile(_GRAMMAR["de"][k]) for k in ("NOT_ABLE", "TASK")] + [re.compile(r"(?:find|erkenn|seh|entnehm|feststell)\w*$")]
_OUTRIGHT = [re.compile(g[k]) for g in _GRAMMAR.values() for k in ("REFUSE", "NORM", "UNFIT")]
MARKER = re.compile(r"</?\s*\w+\s*/?>|```\w*|<\|[^|<>]*\|>|\[/?[A-Z]+\]")
QUOTE = re.compile(r"«[^»]*(?:»|$)|“[^”]*(?:”|$)|\"[^\"]*(?:\"|$)")
QUOTED = re.compile(r"«[^»]*»")
#: Names written as identifiers are labels and no prose.
IDENTIFIER = re.compile(r"\b\w+_\w+\b")
_PAIRS = {"{": "}", "[": "]", "(": ")", "«": "»", "“": "”"}


def complete_map(answer: str) -> tuple[dict | None, str, bool]:
    """The last complete JSON map of an answer, the answer without its complete maps, and whether a brace stays open after them."""
    decode, found, rest, at, hanging = json.JSONDecoder().raw_decode, None, [], 0, False
    while (start := answer.find("{", at)) >= 0:
        rest.append(answer[at:start])
        try:
            value, end = decode(answer, start)
        except (ValueError, RecursionError):
            value, end = None, start + 1
        if isinstance(value, dict):
            found, hanging = value, False
        else:
            end, hanging = start + 1, hanging or "}" not in answer[start:]
        at = end
    rest.append(answer[at:])
    return found, " ".join(rest), hanging


def is_empty(answer: str | None) -> bool:
    """Nothing but blanks, invisible characters and bare markers."""
    return answer is None or not any(c.isalnum() or c in "{}[]" for c in MARKER.sub(" ", answer))


def is_copy(answer: list[str], review: list[str]) -> bool:
    """The answer's words are those of the review, in runs, but for slight changes; the review is there for the most part."""
    if len(review) < 2 or not answer:
        return False
    own, other = set(answer), set(review)
    if len(own & other) < max(0.6 * len(own), 0.5 * len(other)):
        return False
    pairs = set(zip(review, review[1:]))
    runs = sum(p in pairs for p in zip(answer, answer[1:]))
    return runs >= 0.35 * (len(answer) - 1)


def folded(text: str) -> str:
    """Lower case, straight apostrophes, no accents."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text.replace("’", "'").replace("ß", "ss")) if not unicodedata.combining(c))
    return text.lower()


def refuses(prose: str) -> bool:
    """A sentence of the prose declines to do what is asked."""
    for s in _SENTENCE.split(folded(prose)):
        if any(p.search(s) for p in _OUTRIGHT):
            return True
        if any(p.search(s) and me.search(s) for me, p in _ABLE):
            return True
        not_able, task, perceive = _APART
        if not_able.search(s) and task.search(s) and not perceive.search(s.rstrip(" ,;:")):
            return True
    return False


def unclosed(answer: str) -> bool:
    """A bracket, quotation, code fence or reasoning block is opened and not closed. Brackets inside strings of maps don't count."""
    if answer.count("```") % 2 or answer.count("<think>") > answer.count("</think>"):
        return True
    open_: list[str] = []
    for c in re.sub(r'"(?:[^"\\\n]|\\.)*"', " ", answer):
        if c in _PAIRS:
            open_.append(_PAIRS[c])
        elif open_ and c in open_:
            # what a later bracket closes over was left open inside, which its own end settles
            while open_.pop() != c:
                pass
    return bool(open_)


def abrupt(answer: str) -> bool:
    """The answer's last characters are running text without an end: no full stop, bracket, quotation or fence."""
    last = MARKER.sub(lambda m: "." if "/" in m[0] or "`" in m[0] else " ", answer).rstrip()
    while last and unicodedata.category(last[-1]) in ("Cf", "So", "Mn", "Zs"):
        last = last[:-1].rstrip()
    return bool(last) and last[-1] not in ".!?…:;)]}»”\"'*_`>"


@lru_cache(maxsize=1 << 16)
def script(c: str) -> str:
    """The script of a letter, as its Unicode name begins; '' for other characters. Kana and Han go together."""
    if not c.isalpha():
        return ""
    name = unicodedata.name(c, "").split(" ", 1)[0].split("-")[0]
    return "EAST" if name in ("CJK", "HIRAGANA", "KATAKANA", "HALFWIDTH", "IDEOGRAPHIC") else "LATIN" if name in ("FULLWIDTH", "FEMININE", "MASCULINE") else name


def scripts(text: str) -> dict[str, float]:
    """Shares of the scripts among the letters of a text."""
    if text.isascii():
        return {"LATIN": 1.0} if any(map(str.isalpha, text)) else {}
    n = Counter(map(script, text))
    n.pop("", None)
    total = sum(n.values())
    return {s: k / total for s, k in n.items()}


def other_script(prose: str, review: str) -> bool:
    """Most of the prose's letters are of a script that holds less than a tenth of the review's."""
    own, asked = scripts(prose), scripts(review)
    return bool(own and asked) and sum(map(str.isalpha, prose)) >= 4 and asked.get(max(own, key=own.get), 0) < 0.1


def prose_of(rest: str) -> str:
    """An answer's own running text, lines apart: without maps, markers, quotes and identifiers."""
    return IDENTIFIER.sub(" ", QUOTE.sub(" ", MARKER.sub(" . ", rest)))


def defects(df: DataFrame, key: str = "gen_id", question: str = "text", answer: str = "raw_generation", label: str = "language") -> DataFrame:
    """key, rules array<string>, defects array<string>: every rule that an answer triggers, in the order of RULES, and every defect they come to, in that of DEFECTS.

    Each rule is tried on every answer by itself:

    empty      null, or nothing in it but blanks, invisible characters or bare markers
    copied     its words are those of the review in their order, wrapped, repeated or slightly changed, maps and marked quotations aside
    refusal    a sentence of its own prose declines: denied ability, will or permission, a refusing verb, a norm against it
    no_map     there is something, but no complete JSON map, or a further map is begun after the last complete one
    unclosed   a bracket, quotation, fence or reasoning block is opened and not closed
    abrupt     it ends in the middle of running text
    script     the prose is in a script that the review doesn't use
    language   the prose, of four words or more, is in none of the review's languages, or hardly has a frequent word of them

    empty, copied and refusal are defects of that name, no_map is ``truncated`` (what is unclosed or abrupt behind a
    complete map is listed as a rule only), script and language are ``other_language``.  Sound answers have empty
    arrays.  The question may be null or blank: then nothing is copied and no script or language differs.  Extra
    columns are not read.
    """
    table = canon.look_alikes(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(lang.fit(df, question, label, key, seeds=FUNCTION_WORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words, plain = shared.value, canon.folder(table).words, lang.Plain(table)
        for b in batches:
            model.trim()
            rules = [_rules(q, a, words, plain, model) for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rules, pa.list_(pa.string())), pa.array(list(map(_defects, rules)), pa.list_(pa.string()))], names=[name, "rules", "defects"])

    kept = df.select(key, question, answer)
    name = kept.columns[0]
    return kept.mapInArrow(run, f"`{name}` {kept.dtypes[0][1]}, rules array<string>, defects array<string>")


_OF = {"empty": "empty", "copied": "copied", "refusal": "refusal", "no_map": "truncated", "script": "other_language", "language": "other_language"}


def _defects(rules: list[str]) -> list[str]:
    found = {_OF[r] for r in rules if r in _OF}
    return [d for d in DEFECTS if d in found]


def _rules(review: str | None, answer: str | None, words, plain: lang.Plain, model: lang.Model) -> list[str]:
    if answer is None:
        return ["empty"]
    review, answer = plain(review or ""), plain(answer)
    found, rest, hanging = complete_map(answer)
    own, bare = prose_of(rest), MARKER.sub(" ", rest)
    # beside its own words, quoted parts of the review are evidence and not a copy
    unquoted, all_words = words(QUOTED.sub(" ", bare)), words(bare)
    nothing = is_empty(answer)
    hit = {
        "empty": nothing,
        "copied": is_copy(unquoted if 4 * len(unquoted) > len(all_words) else all_words, words(review)),
        "refusal": refuses(own),
        "no_map": not nothing and (found is None or hanging),
        "unclosed": unclosed(answer),
        "abrupt": abrupt(answer),
        "script": other_script(own, review),
        "language": bool(review) and _foreign(review, own, model),
    }
    return [r for r in RULES if hit[r]]


#: Words of prose from which on a lack of frequent words tells, and the share of them that any running text has.
ENOUGH, FREQUENT = 10, 0.15


def _foreign(review: str, own_text: str, model: lang.Model) -> bool:
    own = [w for s in lang.segments(own_text) for w in lang.words_of(s)]
    parts = [w for s in lang.segments(review) if (w := lang.words_of(s))]
    if len(own) < 4 or not parts:
        return False
    sums = model.sums([own, *parts])
    counts = np.array([len(p) for p in parts])
    spoken = [x for x, _, _ in lang.document(sums[1:], counts, lang.decide(sums[1:]), lang.SHARE, lang.SURE)]
    if int(lang.decide(sums[:1])[0]) not in spoken:
        return True
    bare = [folded(w) for w in own]
    return len(bare) >= ENOUGH and max(sum(w in _CLOSED[lang.LANGUAGES[x]] for w in bare) for x in spoken) < FREQUENT * len(bare)


def first_defect(found: DataFrame, key: str = "gen_id") -> DataFrame:
    return found.where(F.size("defects") > 0).select(key, F.col("defects")[0].alias("defect"))
