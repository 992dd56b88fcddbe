"""Documents that hold template residue, filler, error messages or script notices instead of content (problem 8).

Normalised lines are counted by host (the column source), equal texts once. A line that recurs in enough of a host's
texts is the host's boilerplate: menus and credits anywhere; standing sentences, cookie and script banners if they
mostly stand beside other content. It is taken off; a document is excluded if what remains shows an unfilled template, filler,
an error or a script or login notice, and holds no content.

Evidence isn't a list of messages. A notice is a sentence in which two kinds of word meet: something of the web or of
access (page, server, browser, session) and what is wrong with it or asked for (not found, denied, enable,
try again), each by word stems in twelve languages. Templates are told by the syntax of fields, filler by repetition
and the stock words of filler generators.

All of it is built-in expressions. Whether a line is content is settled by its first sentence that is, so evidence is
sought in one sentence of most documents only. What is shuffled are hashes of lines, once for each distinct text, and
counts aggregated map-side; only documents without content, or whose first content recurs, have lines exploded.
Texts whose first two content lines both recur are read on, to their first content that doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidar.runtime import Scratch

RECUR_DOCS = 3
"""A line in so many different texts of a host is boilerplate, if it is also in RECUR_SHARE of them."""
RECUR_SHARE = 0.01
BESIDE_CONTENT = 0.5
"""A sentence, or a line with evidence, is boilerplate only if so great a part of the texts that hold it hold other content."""
DENSE_LETTERS = 12
"""So many letters of a script without spaces are a sentence."""
SHORT_WORDS = 8
"""A line of at most so many words is boilerplate wherever it recurs; without end mark it is a heading or menu."""
REAL_WORDS = 5
NOTICE_WORDS = 40
"""Longer sentences are no notices."""

# Field marks of template languages, and stock words of filler generators.
PLACEHOLDER = (
    r"\{\{[^{}]{0,60}\}\}|\$\{[^{}]{0,60}\}|\$[A-Za-z_]{2,30}\$|<<[^<>]{1,40}>>|<%[^%]{0,60}%>|@@\w{1,40}@@|__[A-Z][A-Z_]{1,30}__|#[A-Z][A-Z_]{2,30}#|%[A-Z_]{3,30}%"
    r"|%\(\w{1,30}\)[sd]|\{%[^%]{0,60}%\}|\{[0-9]{1,2}\}|\{[a-z_]{3,30}\}|\[\[[\w .-]{1,40}\]\]|\[[A-Z_ ]{2,30} HERE\]|\bXXXX+\b|(?:TODO|FIXME|TBD|TBC)\b ?:"
    r"|[\[(<](?i:insert|enter|your|add|hier|bitte|inserire|inserisci|insertar|inserte|inserir|insira|insérer|insérez|[àa] compl[ée]ter|da completare|por completar|a completar|vul|voer|tbd|todo)\b[^\])>]{0,60}[\])>]|[\[(<][^\[\](){}<>]{0,30}: ?(?i:tbd|tbc|todo)[\])>]"
)
FILLER_WORDS = (
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud ullamco laboris nisi "
    "aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur cras eget porta mollis tempus pulvinar ornare tellus vestibulum quod"
)
SAMPLE = (
    r"(?:dummy|sample|filler|placeholder|example|temporary) ?(?:text|copy|content)|(?:content|text) (?:goes|comes) here|(?:your|insert|add|enter) (?:\w+ )?(?:text|content|title) here|coming soon"
    r"|blindtext|platzhalter|fulltext|beispieltext|mustertext|faux texte|texte (?:de remplissage|factice|d'exemple|provisoire)|texto (?:de relleno|de ejemplo|de prueba|simulado|ficticio|de preenchimento|provisorio)"
    r"|testo (?:segnaposto|di riempimento|fittizio|di prova|provvisorio)|voorbeeldtekst|opvultekst|plaatsvervangende tekst|δοκιμαστικο κειμενο|κειμενο (?:δειγμα|επιδειξης)|占位|示例文字|示例文本|填充文本|ダミー|サンプルテキスト|नमूना पाठ|डमी|ข้อความตัวอย่าง|ข้อความจำลอง"
)
# Word stems without accents: things of the web, readers' accounts, objects and means of access; states; requests.
WEB = (
    r"java ?script|scripts?\b|skripte?\b|scripting|cookies?\b|browser|navigateur|navegador|visionneuse|viewer\b|visor(?:e|es)?\b|https?\b|url\b|server|serveur|servidor|gateway|proxy|captcha|firewall"
    r"|php\b|sql\b|sessions?\b|sitzung|sesion|sessione|sessie|sessao|subscriber|registered|abonn|angemeldet|registrierte|inscrits?\b|registrad|registrat|abbonati|suscriptor|geregistreerd|assinante|registado"
    r"|περιηγητη|περιηγησης|διακομιστη|συνεδρια|συνδρομητ|(?:脚本|浏览器|服务器|会话|注册用户|スクリプト|ブラウザ|サーバ|セッション|クッキー|登録|स्क्रिप्ट|ब्राउज़र|ब्राउजर|सर्वर|सत्र|कुकी|पंजीकृत|สคริปต์|เบราว์เซอร์|เซิร์ฟเวอร์|เซสชัน|คุกกี้|สมาชิก)"
)
THING = (
    r"(?:web)?(?:page|site)s?\b|seite\b|internetseite|pages?\b|pagina|sitio|sito\b|files?\b|datei|fichier|fichero|archivo\b|arquivo|bestand\b|documents?\b|dokument|documento|full ?text|volltext|texte integral|texto (?:completo|integral)"
    r"|testo (?:completo|integrale)|volledige tekst|text layer|preview|content|inhalte?\b|contenu|contenido|contenuto|conteudo|inhoud\b|digitalisat|images?\b|bildserver|records?\b|datensatz|registro|notice\b|entry\b|eintrag|volum|band\b|plate\b|tafel\b"
    r"|planche|lamina\b|tavola|services?\b|dienst|servicio|servizio|servico|access|zugriff|zugang|acces\b|acceso|acesso|toegang|permissions?\b|connection|verbindung|connexion|conexion|connessione|verbinding|conexao|requests?\b|anfrage|requete"
    r"|solicitud|solicitad|richiest|angefordert|demande|requested|answer|antwort|reponse|respuesta|risposta|network|netz|reseau|\bred\b|\brete\b|address|adresse|direccion|indirizzo|links?\b|stream|conversion|download|resource|catalog|katalog|portal|digital|numeris|numerique"
    r"|σελιδα|αρχειο|ιστοσελιδα|ιστοτοπο|προσβαση|υπηρεσια|περιεχομενο|συνδεση|(?:页面|网页|网站|文件|服务|访问|内容|连接|链接|请求|ページ|サイト|ファイル|サービス|アクセス|コンテンツ|接続|リンク|पृष्ठ|पेज|साइट|फ़ाइल|फाइल|सेवा|पहुँच|पहुंच|सामग्री|कनेक्शन|หน้า|เว็บไซต์|ไฟล์|บริการ|การเข้าถึง|เนื้อหา|การเชื่อมต่อ|ลิงก์)"
)
STATE = (
    r"(?:not|nicht|no|non|nao|niet|n'a pu|n'ont pu|δεν) (?:[\p{L}']+ ){0,4}?(?:found|available|accessible|responding|readable|loaded|opened|displayed|exist|gefunden|verfugbar|erreichbar|geladen|geoffnet|angezeigt|vorhanden|disponible|disponibile|disponivel|cargad?|cargar|mostrar"
    r"|mostrat|encontrad|trovat|caricat|apert|affich|ouvert|charge|abrir|responde|risponde|beschikbaar|bereikbaar|gevonden|carregad|βρεθηκε|διαθεσιμ|υπαρχει)|unavailable|not found|n'est (?:pas|plus) disponible|ne (?:peut|repond)|introuvable|indisponi|inaccessible"
    r"|cannot be|can't be|could not|couldn't|unable to|unreachable|denied|forbidden|refus|verweigert|verboten|denegad|prohibid|negat[oa]|vietat|negado|proibid|geweigerd|interdit|expire|abgelaufen|caducad|scadut|verlopen|failed|failure|fehlgeschlagen|fehler|schlug fehl"
    r"|error|erreur|errore|erro\b|fout\b|echou|fallo|fallid|fallit|mislukt|removed|deleted|moved\b|renamed|entfernt|umbenannt|geloscht|verschoben|deplace|supprim|movid|eliminad|rimoss|spostat|removid|verwijderd|verplaatst|blocked|gesperrt|bloqu|bloccat|geblokkeerd"
    r"|restricted|reserved|reserve|riservat|reservad|beschrankt|only (?:in|for|to|with)|nur (?:im|in|fur|mit)|que dans|solo (?:en|in|per|para|com)|alleen (?:voor|in)|somente|apenas|(?:timed|time) out|antwortet|maintenance|wartung|mantenimiento|manutenzione|manutencao|onderhoud|under construction|im aufbau|en construction|en construccion|in costruzione"
    r"|em construcao|in aanbouw|damaged|encrypted|empty|leere\b|vide\b|vacia|vuot[oa]|disabled|deaktiviert|desactive|desactivad|disabilitat|uitgeschakeld|code? (?:0x)?[0-9]{2,}|codigo|codice|too many|zu viele|limit (?:of )?(?:[\p{L}\p{N}]+ ){0,3}(?:reached|exceeded)|uberschritten|depass|superad|superat|overschreden|excedid|(?:don't|do not) have|keine berechtigung|nicht berechtigt|sans autorisation|sin permiso|non autorizzat|sem permissao|geen (?:toegang|toestemming)|switched off|turned off|ausgeschaltet|disattivat|abgebrochen"
    r"|απαγορευ|μονο για|δεν υποστηρ|εληξε|σφαλμα|αποτυχια|συντηρηση|κατασκευη|(?:未找到|找不到|不存在|无法|不可用|拒绝|禁止|过期|错误|失败|维护|已被|删除|建设中|禁用|无权|仅限|見つかり|ありません|できません|利用でき|拒否|禁止|期限切れ|切れ|エラー|失敗|メンテナンス|削除|準備中|工事中|無効|のみ"
    r"|नहीं मिल|उपलब्ध नहीं|नहीं हो|नहीं किया|अस्वीकृत|अस्वीकार|समाप्त|त्रुटि|विफल|रखरखाव|निर्माणाधीन|हटा|अक्षम|केवल|अनुमति नहीं|ไม่พบ|ไม่สามารถ|ไม่พร้อม|ไม่มี|ปฏิเสธ|หมดอายุ|ผิดพลาด|ล้มเหลว|ปิดปรับปรุง|บำรุงรักษา|ถูกลบ|ปิดใช้งาน|เฉพาะ|ไม่มีสิทธิ์)"
)
APPEAL = (
    r"enable|activate|allow\b|turn on|switch on|update\b|upgrade|newer|requires?\b|needs?\b|must\b|log(?:ged)? ?(?:in|on)\b|login|sign in|try again|retry|reload|refresh|go back|(?:back|return) to|contact\b|check (?:the|your)\b|loading\b|redirecting|wait\b|apologi[sz]e|sorry|support|technical|administrat|webmaster|help ?desk|notify"
    r"|aktivier|erlaub|zulassen|zugelassen|einschalten|eingeschaltet|neueren|benotigt|erforder|anmelden|melden sie sich|einloggen|erneut|versuchen sie|neu laden|zuruck zu|wenden sie|prufen sie|entschuldig|bitte\b|unterstutz"
    r"|activez|active\b|autoris|permett|plus recent|exige|requiert|necessite|connecte[rz]|identifi|reessayer|rechargez|retour a|contacte[rz]|verifiez|veuillez|excus|a nouveau|de nouveau|avisez|avise\b|tecnico|assistance|assistenza|asistencia|de nuevo|soport|suport|acepte|habilite|habilitad|permit[ae]n?\b|mas reciente|requiere|necesita|inicie|iniciar|inicia|intente|intentelo|vuelva|volver"
    r"|recargue|compruebe|disculp|por favor|attiv|abilit|consent|piu recente|richiede|acced|accesso di nuovo|riprov|ricaric|torna\b|contatt|verific|controll|scus|di nuovo|avvis|ative\b|novamente|ativar|permita|requer|entrar\b|tente\b|recarregue|voltar|desculp|schakel|inschakel|toestaan|vereist|inloggen|log in|probeer|herlaad|terug naar|opnieuw|ondersteun|excuses"
    r"|ενεργοποι|απαιτει|συνδεθει|δοκιμασ|ανανεωσ|παρακαλ|ξανα|υποστηρ|(?:启用|允许|开启|需要|登录|重试|稍后|刷新|返回|请|支持|有効|許可|必要|ログイン|再度|もう一度|後で|再読み込み|戻る|ください|サポート|対応|सक्षम|सक्रिय|अनुमति|आवश्यक|लॉग|पुनः|फिर|दोबारा|कृपया|समर्थ|เปิดใช้|อนุญาต|ต้อง|เข้าสู่ระบบ|ลองใหม่|อีกครั้ง|โหลด|กรุณา|โปรด|รองรับ)"
)
CODE = (
    r"^\W{0,3}(?:[a-z]-?[0-9]{2,}|[45][0-9]{2})\b ?[:–-]|^\W{0,3}[45][0-9]{2}(?: [\p{L}-]+){1,3}\W{0,2}$|(?:error|fehler|errore|erreur|erro|fout|status|http/?[0-9.]*|code|codigo|codice|σφαλμα|错误|エラー|त्रुटि|ข้อผิดพลาด)[ :#]{0,2}(?:[45][0-9]{2}\b|0x[0-9a-f]{2,}|e-?[0-9]{2,})"
    r"|\b\w+(?:error|exception):|traceback \(|stack ?trace|file \"/|\bat line [0-9]|on line [0-9]|intern\w* server|server ?(?:fehler|error|fout)|bad (?:gateway|request)|gateway time|too many requests|just a moment|checking your"
)
_WORD = r"[\p{L}\p{M}]+"
_ACCENTED, _BARE = "áàâäãåéèêëíìîïóòôöõúùûüñçßάέήίόύώϊϋΐΰς", "aaaaaaeeeeiiiiooooouuuuncsαεηιουωιυιυσ"


def _lines(text: Column) -> Column:
    """Lines with visible characters, without invisible marks, blanks squeezed."""
    parts = F.split(F.regexp_replace(text, r"\p{Cf}+", ""), r"\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]")
    return F.filter(F.transform(parts, lambda l: F.trim(F.regexp_replace(l, r"[\s\p{Z}]+", " "))), lambda l: l != "")


def _key(line: Column) -> Column:
    """What lines have in common that differ only in numbers, request codes and case, as two hashes."""
    k = F.regexp_replace(F.lower(line), r"\b[0-9a-f]*[0-9][0-9a-f]*\b|[0-9]+", "0")
    return F.struct(F.xxhash64(k).alias("a"), F.xxhash64(k, F.lit(1)).alias("b"))


def _hash() -> Column:
    """A text as two hashes."""
    return F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"))


def _bare(s: Column) -> Column:
    """In small letters without accents."""
    return F.translate(F.regexp_replace(F.lower(s), r"[\x{300}-\x{36f}]+", ""), _ACCENTED, _BARE)


def _words(s: Column) -> Column:
    return F.regexp_count(s, F.lit(_WORD))


def _any(stems: str) -> str:
    """Stems at the beginnings of words; scripts without spaces are sought anywhere."""
    spaced, _, dense = stems.rpartition("|(?:")
    return rf"(?<![\p{{L}}\p{{N}}])(?:{spaced})" + (f"|{dense.rstrip(')')}" if dense else "")


def _filler(s: Column) -> Column:
    """Most words are stock words of filler, or a few words are repeated over and over, or it says so itself. s in small letters."""
    n = _words(s)
    known = F.regexp_count(s, F.lit(r"(?<![\p{L}\p{N}])(?:" + "|".join(FILLER_WORDS.split()) + r")(?![\p{L}\p{N}])"))
    repeated = lambda t: (F.size(t) >= 6) & (F.size(F.array_distinct(t)) * 4 <= F.size(t))
    return _bound(F.split(F.trim(s), " "), repeated) | ((n >= 3) & (known * 3 >= n)) | s.rlike(SAMPLE)


def _bound(x: Column, f) -> Column:
    """f of x, x worked out once."""
    return F.transform(F.array(x), f)[0]


def _cyclic(line: Column) -> Column:
    """Whether half of a line's pairs of neighbours or more are there again: a few phrases over and over."""

    def again(t: Column) -> Column:
        pairs = F.zip_with(t, F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), F.coalesce(b, F.lit(""))))
        few = (F.size(t) >= 12) & (F.size(F.array_distinct(t)) * 2 <= F.size(t))
        return F.when(few, F.size(F.array_distinct(pairs)) * 2 <= F.size(t)).otherwise(False)

    return _bound(F.split(F.lower(line), r"[^\p{L}\p{M}\p{N}]+"), again)


def _notice(s: Column) -> Column:
    """s in small letters without accents: a thing of the web and what is wrong or asked for, or a thing of access and what is wrong."""
    web, thing, state, appeal = (s.rlike(_any(x)) for x in (WEB, THING, STATE, APPEAL))
    return (s.rlike(CODE) | (state & (web | thing | appeal)) | (appeal & web)) & (_words(s) <= NOTICE_WORDS)


def _evidence(s: Column) -> Column:
    """template, filler or notice; '' if s shows nothing of these."""
    of_bare = lambda b: F.when(_filler(b), "filler").when(_notice(b), "notice")
    return F.coalesce(F.when(s.rlike(PLACEHOLDER), "template").when(_cyclic(s), "filler").otherwise(_bound(_bare(s), of_bare)), F.lit(""))


def _dense(s: Column) -> Column:
    """Scripts without spaces count by letters."""
    return F.regexp_count(s, F.lit(r"[฀-๿぀-ヿ㐀-鿿]")) >= DENSE_LETTERS


def _sentences(line: Column) -> Column:
    return F.split(line, r"(?<=[.!?…])\s+|(?<=[。！？।])")


def _content(line: Column) -> Column:
    """Whether a line holds a real sentence: long enough, without evidence, and asking for nothing."""
    marked = line.rlike(r"[.!?…:;。！？।]['\"”’»)\]]*$")

    def real(s: Column) -> Column:
        clean = lambda b: ~(b.rlike(_any(APPEAL)) | _filler(b) | _notice(b))
        return ((_words(s) >= REAL_WORDS) | _dense(s)) & ~s.rlike(PLACEHOLDER) & _bound(_bare(s), clean)

    return (marked | (_words(line) > SHORT_WORDS) | _dense(line)) & ~_cyclic(line) & F.exists(_sentences(line), real)


def _analysed(df: DataFrame, key: str) -> DataFrame:
    """(key, source, h, keys, first, second, raw): each row's text by hash, its lines' hashes, its first two content lines', and the lines where none is content."""
    rows = df.select(key, F.coalesce("source", F.lit("")).alias("source"), _hash().alias("h"), _lines(F.col("text")).alias("lines"))
    # two suffice for most texts; _recurrent reads on where both recur
    none = F.array().cast("array<string>")
    two = F.aggregate("lines", none, lambda acc, l: F.when(F.size(acc) == 2, acc).when(~F.array_contains(acc, l) & _content(l), F.concat(acc, F.array(l))).otherwise(acc))
    rows = rows.withColumn("two", two)
    first = F.get("two", F.lit(0))
    return rows.select(key, "source", "h", F.transform("lines", _key).alias("keys"), F.when(first.isNotNull(), _key(first)).alias("first"), F.when(F.size("two") == 2, _key(F.get("two", F.lit(1)))).alias("second"), F.when(first.isNull(), F.col("lines")).alias("raw"))


def _recurrent(df: DataFrame, rows: DataFrame, recur_docs: int, keep) -> DataFrame:
    """(source, line, docs, beside): lines in enough different texts of a host, and how many of these texts hold content that doesn't recur."""
    texts = keep(rows.where(F.size("keys") > 0).groupBy("source", "h").agg(F.first("keys").alias("keys"), F.first("first").alias("first"), F.first("second").alias("second")), "texts")
    hosts = texts.groupBy("source").agg(F.count("*").alias("texts"))
    lines = texts.select("source", F.explode(F.array_distinct("keys")).alias("line"))
    often = lines.groupBy("source", "line").agg(F.count("*").alias("docs")).where(F.col("docs") >= recur_docs)
    often = keep(often.join(hosts, "source").where(F.col("docs") >= RECUR_SHARE * F.col("texts")).select("source", "line", "docs"), "often")
    further = keep(_further(df, texts, often, keep), "further")
    for c in ("first", "second"):
        texts = texts.join(often.select("source", F.col("line").alias(c), F.lit(True).alias("recurs")), ["source", c], "left").withColumn(c, F.when(F.col("recurs").isNull(), F.col(c))).drop("recurs")
    texts = texts.join(further.withColumn("further", F.lit(True)), ["source", "h"], "left")
    texts = texts.select("source", (F.col("first").isNotNull() | F.col("second").isNotNull() | F.col("further").isNotNull()).alias("content"), F.explode(F.array_distinct("keys")).alias("line"))
    return texts.join(often, ["source", "line"]).groupBy("source", "line").agg(F.first("docs").alias("docs"), F.count_if("content").alias("beside"))


def _further(df: DataFrame, texts: DataFrame, often: DataFrame, keep) -> DataFrame:
    """(source, h): of the texts whose first two content lines recur, those with content further on that doesn't."""
    unsure = texts.where("second is not null").select("source", "h", "first", "second")
    for c in ("first", "second"):
        unsure = unsure.join(often.select("source", F.col("line").alias(c)), ["source", c], "left_semi")
    unsure = keep(unsure.select("source", "h"), "unsure")
    if unsure.isEmpty():
        return unsure
    places = texts.select("source", "h", "keys").join(unsure, ["source", "h"], "left_semi").select("source", "h", F.posexplode("keys").alias("place", "line"))
    places = places.join(often, ["source", "line"], "left_anti").groupBy("source", "h").agg(F.sort_array(F.collect_list("place")).alias("places"))
    whole = df.select(F.coalesce("source", F.lit("")).alias("source"), _hash().alias("h"), "text").join(unsure, ["source", "h"], "left_semi")
    whole = whole.groupBy("source", "h").agg(F.first("text").alias("text")).join(places, ["source", "h"])
    return whole.where(_bound(_lines(F.col("text")), lambda lines: F.exists("places", lambda i: _content(F.get(lines, i))))).select("source", "h")


def boilerplate(df: DataFrame, recur_docs: int = RECUR_DOCS) -> DataFrame:
    """(source, line struct<a, b>, docs, beside): lines that recur in different texts of a host, by their hashes, and how many of these texts hold other content. A null source is a host of its own."""
    keep = Scratch(df.sparkSession).keep
    return _recurrent(df, keep(_analysed(df.select("source", "text", F.lit(0).alias("doc_id")), "doc_id"), "rows"), recur_docs, keep)


def residue(df: DataFrame, recur_docs: int = RECUR_DOCS) -> DataFrame:
    """(doc_id, kinds array<string>) of each document to leave out, with the evidence found in it.

    df has doc_id, text, source; other columns are ignored. Null, empty and blank texts are no case.
    Rows are judged one by one; a doc_id comes once if one of its rows is a case.
    """
    keep = Scratch(df.sparkSession).keep
    rows = keep(_analysed(df, "doc_id"), "rows")
    common = keep(_recurrent(df, rows, recur_docs, keep), "recurrent")
    bare = rows.where("raw is not null").select("doc_id", "source", F.col("h.a").alias("h"), F.explode("raw").alias("raw"))
    # documents whose first content recurs in their host: the rest of their lines decides
    again = keep(rows.where("first is not null").join(common.select("source", F.col("line").alias("first")), ["source", "first"], "left_semi").select("doc_id"), "again")
    more = df.select("doc_id", "source", "text").join(again, "doc_id", "left_semi")
    more = more.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("text").alias("h"), F.explode(_lines(F.col("text"))).alias("raw"))
    lines = bare.unionByName(more).withColumn("line", _key(F.col("raw"))).join(common, ["source", "line"], "left")
    seen = lines.select("doc_id", "h", "raw", _evidence(F.col("raw")).alias("kind"), F.col("docs").isNotNull().alias("common"), (F.col("beside") >= BESIDE_CONTENT * F.col("docs")).alias("beside"))
    menu = (F.col("kind") == "") & (_words(F.col("raw")) <= SHORT_WORDS) & ~_dense(F.col("raw"))
    rest = seen.where(~(F.col("common") & (F.col("beside") | menu)))
    judged = rest.groupBy("doc_id", "h").agg(F.bool_or(_content(F.col("raw"))).alias("content"), F.collect_set(F.when(F.col("kind") != "", F.col("kind"))).alias("kinds"))
    return judged.where(~F.col("content") & (F.size("kinds") > 0)).groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"))
