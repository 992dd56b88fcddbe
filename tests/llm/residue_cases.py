"""Notices, templates and filler, and short contents, written for the tests apart from any table."""

RESIDUE = """
502 Bad Gateway
Service Unavailable
The server is temporarily unable to service your request. Please try again later.
Site under construction
Your content goes here…
Oops! That page can't be found.
This site requires cookies. Please enable cookies in your browser settings and reload.
We've detected that JavaScript is disabled in your browser.
HTTP Error 403 – Forbidden
Your connection timed out.
Please sign in to continue. Your session is no longer valid because it expired.
File not found: the document you requested no longer exists on our server.
Dear {{first_name}}, thank you for visiting %SITE_NAME% on [[date]].
Lorem ipsum dolor sit amet, consectetuer adipiscing elit.
Seite nicht gefunden
Bitte aktivieren Sie JavaScript, um diese Webseite nutzen zu können.
Zugriff verweigert. Sie haben keine Berechtigung, dieses Dokument zu öffnen.
Ihre Sitzung ist abgelaufen, bitte melden Sie sich neu an.
Der Server ist derzeit nicht erreichbar. Versuchen Sie es später noch einmal.
Hier steht ein Blindtext, der später durch Inhalte ersetzt wird.
Página no encontrada
Para continuar, habilite las cookies en su navegador.
Error interno del servidor. Vuelva a intentarlo en unos minutos.
Su sesión ha expirado; inicie sesión otra vez.
Este es un texto de ejemplo para la página principal.
Página não encontrada
O seu navegador não suporta JavaScript ou está desativado.
Serviço indisponível. Tente novamente mais tarde.
Acesso negado: não tem permissão para ver este ficheiro.
Page introuvable
Veuillez activer JavaScript dans votre navigateur pour continuer.
Le serveur ne répond pas. Réessayez dans quelques instants.
Votre session a expiré, veuillez vous reconnecter.
Ce site est en construction.
Pagina non trovata
Il tuo browser non supporta i cookie oppure sono disabilitati.
Accesso vietato: devi effettuare il login per vedere questo contenuto.
Il server non risponde. Riprova più tardi.
Pagina niet gevonden
Schakel JavaScript in om deze website te gebruiken.
De server is tijdelijk niet bereikbaar. Probeer het later opnieuw.
Η σελίδα δεν βρέθηκε
Ενεργοποιήστε τη JavaScript στο πρόγραμμα περιήγησής σας.
Η υπηρεσία δεν είναι διαθέσιμη. Δοκιμάστε ξανά αργότερα.
页面不存在或已被删除
请在浏览器中启用JavaScript后继续访问。
服务器错误，请稍后重试。
ページが見つかりません
JavaScriptを有効にしてからもう一度お試しください。
サーバーに接続できませんでした。後ほど再度アクセスしてください。
पृष्ठ नहीं मिला
कृपया अपने ब्राउज़र में जावास्क्रिप्ट सक्षम करें।
सेवा अभी उपलब्ध नहीं है, कृपया बाद में पुनः प्रयास करें।
ไม่พบหน้าที่คุณต้องการ
กรุณาเปิดใช้งาน JavaScript ในเบราว์เซอร์ของคุณ
เซิร์ฟเวอร์ไม่พร้อมให้บริการ โปรดลองใหม่อีกครั้งภายหลัง
test test test test test test test test
""".strip().split("\n")

CONTENT = """
The inscription was not found in the second campaign of excavation.
Status: 12 sherds.
The settlers moved the boundary stone and closed the old gate.
Bronze fibula, length 4.2 cm, from grave 17.
Two coins of Hadrian were recovered below the floor of room 4.
The king denied the city its market rights in 1204.
No pottery later than the third century was found in the ditch.
The wall failed during the siege and was rebuilt with reused blocks.
Der Brunnen wurde im 14. Jahrhundert aufgegeben und verfüllt.
Die Siedlung bestand aus 23 Häusern und einem Tempel.
Ein Fehler im Fundament führte zum Einsturz des Turmes.
Im Grab lagen zwei Schwerter, aber keine Gefäße.
La necrópolis fue abandonada hacia el año 300.
Se hallaron tres ánforas junto a la muralla.
El acceso a la cámara funeraria se hacía por un corredor.
O castro foi ocupado desde a Idade do Ferro.
As moedas encontradas datam do reinado de Trajano.
Le temple fut détruit par un incendie au IIe siècle.
La porte nord fut bloquée par un mur tardif.
On y trouva une statue de marbre sans tête.
Il teatro fu restaurato sotto Adriano.
La strada romana attraversava il fiume su un ponte.
La porta orientale fu chiusa nel medioevo.
De grafheuvel werd in de bronstijd opgeworpen.
Er zijn geen sporen van bewoning uit de ijzertijd gevonden.
Ο ναός χτίστηκε τον πέμπτο αιώνα π.Χ.
Στον τάφο βρέθηκαν δύο χρυσά στεφάνια.
该墓葬出土了三件青铜器和若干陶片。
城墙建于公元前二世纪，后经多次修缮。
墓室内没有发现任何铭文。
この古墳は五世紀に築造されたと考えられる。
土器の破片が住居跡から多数出土した。
石室には副葬品が残っていなかった。
यह मंदिर पाँचवीं शताब्दी में बनाया गया था।
खुदाई में तीन सिक्के और मिट्टी के बर्तन मिले।
เจดีย์องค์นี้สร้างขึ้นในสมัยสุโขทัย
พบเศษเครื่องปั้นดินเผาจำนวนมากในชั้นดินที่สอง
Tafel 3
Inhaltsverzeichnis
Zahl der Grabungen nach Jahren
""".strip().split("\n")
