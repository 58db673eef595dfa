"""Phrases of nine languages that the moderation model is trained on, beside judged examples.

They were written from general knowledge of these languages, without reading
any table of documents; ``tests/llm`` asserts that none of them stands in one.
Each language has templates and what fills them with and without harm, so that
the words around a harmful one count for nothing, and phrases of both kinds.
``{i}`` is a person's name of either sort, ``{g}`` a people.
"""

from __future__ import annotations

from collections.abc import Iterator

# Templates, then harmful and harmless fillings.
INSULTS = {
    "en": (
        "you {i}|you are a {i}|you're such a {i}|what a {i}|you really are a {i}, you know|he is nothing but a {i}|get lost, {i}|listen, you {i}",
        "idiot|moron|imbecile|bastard|asshole|arsehole|dickhead|fucker|motherfucker|piece of shit|shithead|scumbag|cunt|bitch|whore|slut|loser|dumbass|retard|cretin|halfwit|nitwit|jackass|prick|wanker|twat|douchebag|pig|swine|worm|maggot|filthy rat|stupid cow|worthless fool|dimwit|numskull|lowlife|coward|pathetic clown|dirty liar|brainless oaf|son of a bitch|good-for-nothing|disgusting creep|waste of space|waste of air|failure of a human being|stupid dog|ugly hag|fat pig|dumb sheep|useless idiot|stupid brat",
        "teacher|good friend|doctor|careful translator|driver|very kind person|hero|captain|baker|sailor|great singer|reader|member of the crew|child|genius|lucky man|brave woman|guest|neighbour|late sleeper|quick learner|student|colleague|fan of the show|worker|good cook|night owl|lifesaver",
    ),
    "fr": (
        "espèce de {i}|tu es un {i}|t'es vraiment qu'un {i}|quel {i}|sale {i}|va-t'en, {i}|ce n'est qu'un {i}|pauvre {i}",
        "connard|connasse|con|conne|salaud|salope|enculé|fils de pute|pute|crétin|abruti|imbécile|débile|bouffon|ordure|merde|enfoiré|trou du cul|bâtard|idiot|raté|minable|porc|truie|chien galeux|vermine|pourriture|raclure|déchet|taré|crevure|tocard|lâche|bon à rien|moins que rien|gros naze|pauvre type|cloporte|fumier",
        "professeur|ami|médecin|traducteur|bon camarade|capitaine|voisin|héros|lecteur|marin|enfant|grand artiste|collègue|spécialiste|homme heureux|bon cuisinier|élève|invité|champion|chanteur",
    ),
    "de": (
        "du {i}|du bist ein {i}|was für ein {i}|so ein {i}|ihr seid alle {i}|verschwinde, du {i}|er ist nichts als ein {i}|dieser {i}",
        "Arschloch|Idiot|Vollidiot|Vollpfosten|Trottel|Depp|Dummkopf|Schwachkopf|Wichser|Hurensohn|Hure|Schlampe|Fotze|Drecksau|Dreckskerl|Schwein|Missgeburt|Bastard|Versager|Mistkerl|Scheißkerl|Penner|Spast|Blödmann|Hohlkopf|Miststück|Sackgesicht|Pisser|Nichtsnutz|Abschaum|Dreckstück|dumme Kuh|blöde Sau|elender Feigling|Volltrottel|Scheusal|Lump|Arschgesicht|wertloses Stück Dreck|mieses Stück Scheiße",
        "Lehrer|guter Freund|Arzt|Übersetzer|Kapitän|Nachbar|Held|Leser|Matrose|Kind|großer Künstler|Kollege|Fachmann|Glückspilz|guter Koch|Schüler|Gast|Sänger|Gewinner|Bäcker",
    ),
    "es": (
        "eres un {i}|qué {i} eres|maldito {i}|pedazo de {i}|lárgate, {i}|no eres más que un {i}|oye, {i}|eres una {i}",
        "imbécil|idiota|estúpido|estúpida|gilipollas|cabrón|cabrona|hijo de puta|puta|puto|zorra|mierda|capullo|pendejo|pendeja|cretino|tarado|inútil|subnormal|basura|escoria|cerdo|perra|perro asqueroso|malnacido|bastardo|canalla|fracasado|retrasado|mamón|desgraciado|cobarde|asqueroso|lameculos|rata inmunda|payaso patético|gusano|don nadie|bruto|tonto del culo",
        "maestro|buen amigo|médico|traductor|capitán|vecino|héroe|lector|marinero|niño|gran artista|compañero|experto|hombre feliz|buen cocinero|alumno|invitado|campeón|cantante|panadero",
    ),
    "pt": (
        "você é um {i}|tu és um {i}|seu {i}|que {i}|sua {i}|vai embora, {i}|não passas de um {i}|és mesmo um {i}",
        "idiota|imbecil|estúpido|estúpida|burro|cretino|otário|babaca|filho da puta|puta|vadia|cabrão|merda|desgraçado|canalha|vagabundo|vagabunda|bastardo|nojento|porco|lixo|escroto|arrombado|retardado|palhaço ridículo|verme|inútil|fracassado|cobarde|covarde|corno|parvo|anormal|animal nojento|monte de merda|pedaço de merda|besta|vaca|asqueroso|zé-ninguém",
        "professor|bom amigo|médico|tradutor|capitão|vizinho|herói|leitor|marinheiro|menino|grande artista|colega|perito|homem feliz|bom cozinheiro|aluno|convidado|campeão|cantor|padeiro",
    ),
    "ru": (
        "ты {i}|какой же ты {i}|да ты просто {i}|эй, {i}|пошёл отсюда, {i}|вот {i}|вы все {i}|он просто {i}|жалкий {i}",
        "идиот|идиотка|дурак|дура|кретин|дебил|придурок|мразь|тварь|сволочь|ублюдок|подонок|урод|уродина|скотина|сука|сучка|шлюха|козёл|мудак|говно|дерьмо|гад|гнида|свинья|тупица|болван|ничтожество|выродок|недоумок|падла|паскуда|засранец|пидор|гандон|чмо|долбоёб|тупая корова|крыса|кусок дерьма|идиоты|уроды|твари",
        "учитель|хороший друг|врач|переводчик|капитан|сосед|герой|читатель|моряк|ребёнок|великий артист|коллега|знаток|счастливый человек|хороший повар|ученик|гость|чемпион|певец|пекарь",
    ),
    "ja": (
        "お前は{i}だ|この{i}|この{i}め|{i}が|なんて{i}だ|あいつはただの{i}だ|黙れ、{i}|{i}野郎|てめえみたいな{i}はいらない",
        "馬鹿|バカ|クズ|くず|ゴミ|ゴミクズ|間抜け|マヌケ|アホ|阿呆|ブス|デブ|ブタ|豚|カス|役立たず|能無し|畜生|くそったれ|クソ|糞|クソガキ|クソババア|ろくでなし|負け犬|下衆|ゲス|外道|人間のクズ|ド阿呆|愚か者|虫けら|ヘタレ|キモい奴|腰抜け|最低の女|売女|ビッチ",
        "先生|友達|医者|翻訳者|船長|隣人|英雄|読者|船乗り|子供|芸術家|同僚|専門家|料理人|生徒|客|歌手|パン屋|大人|天才",
    ),
    "ko": (
        "너는 {i}야|이 {i}야|이런 {i}|진짜 {i} 같은 놈|{i} 같으니|꺼져, 이 {i}|저 {i} 좀 봐|넌 그냥 {i}일 뿐이야",
        "바보|멍청이|병신|개새끼|새끼|미친놈|미친년|쓰레기|씨발놈|씨발년|썅년|개자식|등신|찌질이|또라이|쌍놈|걸레|창녀|돼지|벌레|머저리|얼간이|인간쓰레기|년놈|개년|좆같은 놈|호구|거지새끼|버러지|짐승|못난이|겁쟁이|더러운 놈|쓸모없는 인간|한심한 놈",
        "선생님|친구|의사|번역가|선장|이웃|영웅|독자|선원|아이|예술가|동료|전문가|요리사|학생|손님|가수|제빵사|어른|천재",
    ),
    "zh": (
        "你是{i}|你这个{i}|你真是个{i}|他就是个{i}|滚开，{i}|闭嘴，你这{i}|什么{i}|死{i}",
        "白痴|傻瓜|傻逼|笨蛋|蠢货|蠢猪|废物|混蛋|王八蛋|贱人|婊子|畜生|人渣|垃圾|狗东西|杂种|败类|脑残|猪头|狗娘养的|混账|白眼狼|贱货|臭婊子|废柴|没用的东西|下贱的东西|窝囊废|神经病|孬种|无耻的家伙|骗子混蛋|狗屎|丑八怪|智障|弱智|禽兽",
        "老师|好朋友|医生|翻译|船长|邻居|英雄|读者|水手|孩子|艺术家|同事|专家|厨师|学生|客人|歌手|面包师|大人|天才",
    ),
}

# Insults, threats and wishes of harm that are whole phrases.
ABUSE = {
    "en": "shut up|shut the fuck up|shut your mouth, idiot|fuck you|fuck off|go fuck yourself|screw you|go to hell|drop dead|go die|kill yourself|go kill yourself|go hang yourself|I hope you die|I hope you die slowly|I hope you get cancer|I hope you rot in hell|hope you choke on it|nobody would miss you|everyone hates you|nobody loves you|you should never have been born|the world would be better without you|you deserve to die|you deserve every bit of pain|you make me sick|you disgust me|you are worthless|you are so stupid|how stupid are you|you're dumb as a rock|are you brain dead|you are useless|you're pathetic|you are a disgrace|I will kill you|I'm going to kill you|I'll kill you and your family|I will break your legs|I'll break every bone in your body|I will cut your throat|I'll slit your throat|I'll gut you|I'm going to stab you|I will beat you to death|I'll beat the shit out of you|I'll punch your face in|I'll tear your head off|I will find you and hurt you|watch your back|you are dead meat|you'll pay for this with your blood|you will bleed|one day I will burn your house with you in it|I'll smash your skull|I will strangle you|I'll bury you alive|may you burn in hell|may you die alone|no one wants you here, freak|you smell like garbage|you stink, you pig|look at your ugly face|your mother is a whore|what a stupid cow you are|kiss my ass|eat shit|bite me, asshole|you fucking idiot|stupid fucking moron|crawl back into your hole|you ought to be shot|someone should shoot you|you should be ashamed of existing|get cancer and die|jump off a bridge|throw yourself under a train|hang yourself",
    "fr": "ferme ta gueule|ta gueule|va te faire foutre|va te faire enculer|nique ta mère|va crever|crève|crève, sale chien|va en enfer|je vais te tuer|je vais te casser la gueule|je vais te crever|je vais te briser les jambes|je vais t'égorger|je vais te démolir|je vais te défoncer|je te casserai les dents|je te retrouverai et tu vas payer|tu vas mourir|tu mérites de mourir|j'espère que tu vas crever|j'espère que tu mourras|tu ne vaux rien|tu es nul|tu es trop bête|tu es vraiment stupide|tu me dégoûtes|personne ne t'aime|tout le monde te déteste|va te pendre|suicide-toi|tue-toi|tu pues|t'es moche|ta mère est une pute|je t'emmerde|dégage, connard|tu n'aurais jamais dû naître|pauvre con|putain de connard|casse-toi|le monde serait meilleur sans toi|je sais où tu habites|tu es la honte de ta famille|va mourir|brûle en enfer",
    "de": "halt die Fresse|halt's Maul|halt dein Maul|fick dich|verpiss dich|leck mich am Arsch|fahr zur Hölle|verrecke|verreck doch|stirb|geh sterben|bring dich um|häng dich auf|erhäng dich|ich bringe dich um|ich bring dich um|ich mach dich kalt|ich schlag dich tot|ich schlage dir die Zähne ein|ich breche dir alle Knochen|ich breche dir die Beine|ich steche dich ab|ich schneide dir die Kehle durch|ich prügel dich windelweich|ich schlag dir den Schädel ein|ich finde dich und dann bist du tot|ich weiß, wo du wohnst|du bist wertlos|du bist so dumm|du bist strohdumm|wie blöd bist du eigentlich|du bist zu blöd zum Atmen|du widerst mich an|du kotzt mich an|niemand mag dich|alle hassen dich|niemand würde dich vermissen|du hättest nie geboren werden sollen|ich hoffe, du stirbst|hoffentlich verreckst du|hoffentlich bekommst du Krebs|du gehörst erschossen|man sollte dich erschießen|du stinkst|du bist hässlich|deine Mutter ist eine Hure|friss Scheiße|blöder Idiot|dummes Arschloch|die Welt wäre ohne dich besser|schmor in der Hölle|du bist eine Schande|dich braucht keiner",
    "es": "cállate la boca|cierra el pico, idiota|vete a la mierda|vete al infierno|que te jodan|jódete|que te den por culo|chinga tu madre|muérete|ojalá te mueras|ojalá te pudras|ojalá te atropelle un coche|te voy a matar|voy a matarte|te voy a romper la cara|te voy a partir las piernas|te voy a romper los dientes|te voy a degollar|te cortaré el cuello|te voy a reventar|te arrancaré la cabeza|sé dónde vives y te encontraré|vas a morir|mereces morir|no vales nada|das asco|me das asco|eres tan tonto|qué estúpido eres|nadie te quiere|todos te odian|nadie te echaría de menos|mátate|ahórcate|suicídate|apestas|qué fea eres|tu madre es una puta|me cago en tu madre|come mierda|púdrete en el infierno|no deberías haber nacido|el mundo estaría mejor sin ti|eres una vergüenza|te vas a arrepentir con sangre|maldito hijo de puta|hay que pegarte un tiro",
    "pt": "cala a boca|cala-te, idiota|vai à merda|vai para o inferno|vai se foder|vai-te foder|foda-se, seu idiota|vai tomar no cu|morre|vai morrer|espero que morras|espero que você morra|tomara que morra|eu vou te matar|vou matar-te|vou partir-te a cara|vou quebrar a sua cara|vou te quebrar os dentes|vou partir-te as pernas|vou cortar a tua garganta|vou acabar contigo|vou arrebentar você|arranco-te a cabeça|sei onde você mora|você vai morrer|mereces morrer|você não vale nada|não vales nada|tenho nojo de ti|você me dá nojo|és tão burro|como você é burro|ninguém gosta de você|ninguém gosta de ti|todos te odeiam|mata-te|se mata|enforca-te|cheiras mal, porco|és feia|a tua mãe é uma puta|come merda|apodrece no inferno|nunca devias ter nascido|o mundo seria melhor sem você|és uma vergonha|maldito filho da puta|devias levar um tiro",
    "ru": "заткнись|заткни пасть|закрой рот, идиот|пошёл на хуй|иди на хуй|иди к чёрту|пошёл к чёрту|катись в ад|сдохни|чтоб ты сдох|надеюсь, ты сдохнешь|умри|я тебя убью|я убью тебя|я тебя прикончу|я тебя зарежу|я тебе шею сверну|я переломаю тебе ноги|я выбью тебе зубы|я перережу тебе горло|я размозжу тебе голову|я тебя закопаю|я знаю, где ты живёшь|тебе конец|ты труп|ты заслуживаешь смерти|ты ничего не стоишь|ты никому не нужен|тебя все ненавидят|тебя никто не любит|какой же ты тупой|ты такая тупая|ты мне противен|меня от тебя тошнит|убей себя|повесься|лучше бы ты не родился|мир был бы лучше без тебя|от тебя воняет|твоя мать шлюха|жри дерьмо|гори в аду|ты позор семьи|мразь поганая|тупая скотина|тебя надо пристрелить",
    "ja": "死ね|死んでしまえ|さっさと死ね|くたばれ|くたばっちまえ|消えろ|消え失せろ、クズ|黙れ、馬鹿|うるせえ、バカ|殺すぞ|殺してやる|お前を殺す|ぶっ殺す|ぶっ殺してやる|ぶん殴るぞ|ぶっ飛ばすぞ|叩きのめしてやる|首を絞めてやる|喉を切り裂いてやる|歯をへし折ってやる|足の骨を折ってやる|刺してやる|地獄に落ちろ|お前なんか生まれてこなければよかった|お前には生きる価値がない|誰もお前なんか好きじゃない|みんなお前が嫌いだ|お前の顔を見ると吐き気がする|気持ち悪いんだよ|頭おかしいんじゃないか、この馬鹿|首を吊れ|自殺しろ|家に火をつけてやる|お前の家を知っているぞ、覚悟しろ|ふざけるな、クソ野郎|ざまあみろ、負け犬|臭いんだよ、ブタ|お前は最低だ|役立たずは消えろ",
    "ko": "닥쳐|입 닥쳐|꺼져|꺼져 버려|죽어|죽어 버려|뒈져|뒈져라|나가 죽어|죽여 버릴 거야|너를 죽일 거야|죽여 버리겠어|때려죽이겠어|네 목을 따 버릴 거야|다리를 부러뜨려 버릴 거야|이를 다 부숴 버릴 거야|칼로 찔러 버릴 거야|패 죽일 거야|지옥에나 가|지옥에 떨어져라|너 같은 건 태어나지 말았어야 했어|너는 살 가치가 없어|아무도 널 좋아하지 않아|모두가 널 싫어해|너만 보면 토할 것 같아|역겨운 놈|씨발|씨발 꺼져|엿 먹어|좆 까|병신 같은 새끼|목이나 매|자살해|네 엄마는 창녀야|못생긴 게|냄새나는 돼지|네가 어디 사는지 알아, 각오해|네 집에 불을 질러 버릴 거야|멍청한 놈|한심한 인간",
    "zh": "闭嘴|闭上你的臭嘴|去死|去死吧|你去死|滚|滚蛋|给我滚|他妈的|操你妈|去你妈的|草泥马|我要杀了你|我要宰了你|我会弄死你|老子弄死你|我要打断你的腿|我要割断你的喉咙|我要打碎你的牙|我要掐死你|捅死你|砍死你|烧了你家|我知道你住在哪里，你等着|你不得好死|下地狱吧|希望你早点死|你怎么不去死|你根本不配活着|你活着浪费空气|没有人喜欢你|大家都讨厌你|你一文不值|看到你就恶心|你真恶心|你太蠢了|你蠢得像猪|你是不是没长脑子|上吊吧|自杀吧|你妈是婊子|吃屎去吧|不要脸|丑死了|你就不该生下来",
}

# What is said of a people, with harm and without; {g} is its name.
PEOPLES = {
    "en": (
        "those {g}|the {g}|all {g}|these foreigners|immigrants|that tribe|people from over there|their kind",
        "{g} are vermin|{g} are animals|{g} are subhuman|{g} are parasites|{g} are a plague|{g} are filth|{g} are scum|{g} are cockroaches|{g} are rats and should be treated like rats|{g} are savages|{g} are a cancer on this land|{g} should be exterminated|{g} should be wiped out|{g} must be wiped off the map|{g} should be gassed|{g} should all be shot|{g} should be hanged|{g} should burn|{g} deserve to die|{g} do not deserve to live|{g} are not human|{g} are an inferior race|{g} breed like rabbits|{g} are lazy and dirty by nature|{g} are all criminals|{g} are all thieves|{g} cannot be trusted, it is in their blood|{g} should be deported, every last one|throw {g} out of our country|kill all {g}|death to {g}|hang {g} from the lampposts|drown {g} in the sea|get rid of {g}|we must cleanse the land of {g}|beat up {g} wherever you meet them|never let {g} into a decent shop|burn the homes of {g}|{g} stink|{g} are stupid by birth|{g} ruin every town they come to|{g} belong in cages|the only good one of {g} is a dead one|spit on {g}|drive {g} into the sea|no decent person marries one of {g}",
        "{g} are farmers|{g} are good sailors|{g} live by the river|{g} have a rich language|{g} are our neighbours|{g} came here long ago|{g} celebrate in spring|{g} speak two languages|we visited {g} last year|a film about {g}|{g} bake good bread|{g} should be named in the credits|{g} are shown in the first scene|we welcome {g} to our country|houses of {g} are made of stone|{g} should all be subtitled the same way|the history of {g}|{g} won the match",
    ),
    "fr": (
        "ces {g}|les {g}|tous les {g}|ces étrangers|les immigrés|ces gens-là",
        "{g} sont de la vermine|{g} sont des animaux|{g} sont des rats|{g} sont des parasites|{g} sont des cafards|{g} sont des sous-hommes|{g} sont tous des voleurs|{g} sont tous des criminels|{g} sont une race inférieure|il faut exterminer {g}|il faut tous tuer {g}|mort à {g}|dehors, {g}|{g} dehors|il faut chasser {g} du pays|{g} ne méritent pas de vivre|{g} puent|qu'on brûle les maisons de {g}|{g} sont sales et paresseux|à mort {g}|qu'on pende {g}|{g} sont une peste|{g} devraient tous crever|on devrait gazer {g}|jetez {g} à la mer",
        "{g} sont des paysans|{g} sont de bons marins|{g} vivent près du fleuve|{g} sont nos voisins|{g} parlent deux langues|un film sur {g}|{g} fêtent le printemps|nous avons rencontré {g}|{g} font du bon pain|l'histoire de {g}|bienvenue à {g}",
    ),
    "de": (
        "diese {g}|die {g}|alle {g}|diese Ausländer|die Fremden|solche Leute",
        "{g} sind Ungeziefer|{g} sind Tiere|{g} sind Ratten|{g} sind Parasiten|{g} sind Abschaum|{g} sind Untermenschen|{g} sind keine Menschen|{g} sind alle Verbrecher|{g} sind alle Diebe|{g} sind eine minderwertige Rasse|man muss {g} ausrotten|man sollte {g} vergasen|man sollte {g} erschießen|{g} gehören an die Wand gestellt|Tod {g}|{g} raus|raus mit {g}|{g} müssen weg|{g} stinken|{g} haben kein Recht zu leben|brennt die Häuser von {g} nieder|{g} sind dreckig und faul|{g} sind eine Seuche|schlagt {g} tot|hängt {g} auf|werft {g} ins Meer",
        "{g} sind Bauern|{g} sind gute Seeleute|{g} leben am Fluss|{g} sind unsere Nachbarn|{g} sprechen zwei Sprachen|ein Film über {g}|{g} feiern im Frühling|wir haben {g} besucht|{g} backen gutes Brot|die Geschichte von {g}|willkommen bei {g}",
    ),
    "es": (
        "esos {g}|los {g}|todos los {g}|esos extranjeros|los inmigrantes|esa gente",
        "{g} son alimañas|{g} son animales|{g} son ratas|{g} son parásitos|{g} son escoria|{g} son basura|{g} son cucarachas|{g} no son personas|{g} son todos ladrones|{g} son todos criminales|{g} son una raza inferior|hay que exterminar a {g}|hay que matar a {g}|muerte a {g}|fuera {g}|hay que echar a {g} del país|{g} no merecen vivir|{g} apestan|quemad las casas de {g}|{g} son sucios y vagos|{g} son una plaga|habría que gasear a {g}|colgad a {g}|que se ahoguen {g}",
        "{g} son campesinos|{g} son buenos marineros|{g} viven junto al río|{g} son nuestros vecinos|{g} hablan dos idiomas|una película sobre {g}|{g} celebran la primavera|visitamos a {g}|{g} hacen buen pan|la historia de {g}|bienvenidos {g}",
    ),
    "pt": (
        "esses {g}|os {g}|todos os {g}|esses estrangeiros|os imigrantes|essa gente",
        "{g} são vermes|{g} são animais|{g} são ratos|{g} são parasitas|{g} são escória|{g} são lixo|{g} são baratas|{g} não são gente|{g} são todos ladrões|{g} são todos criminosos|{g} são uma raça inferior|é preciso exterminar {g}|é preciso matar {g}|morte a {g}|fora com {g}|{g} deviam ser expulsos do país|{g} não merecem viver|{g} fedem|queimem as casas de {g}|{g} são sujos e preguiçosos|{g} são uma praga|deviam gasear {g}|enforquem {g}|que se afoguem {g}",
        "{g} são agricultores|{g} são bons marinheiros|{g} vivem junto ao rio|{g} são nossos vizinhos|{g} falam duas línguas|um filme sobre {g}|{g} festejam a primavera|visitámos {g}|{g} fazem bom pão|a história de {g}|bem-vindos {g}",
    ),
    "ru": (
        "эти {g}|все {g}|эти чужаки|приезжие|мигранты|такие люди",
        "{g} — паразиты|{g} — животные|{g} — крысы|{g} — отбросы|{g} — нелюди|{g} не люди|{g} — низшая раса|{g} все воры|{g} все преступники|{g} — тараканы|{g} — чума|надо истребить, {g} не должны жить|всех убить, {g} это заслужили|смерть им, {g}|{g}, вон отсюда|гнать их из страны, {g}|{g} не заслуживают жизни|{g} воняют|сжечь их дома, {g}|{g} грязные и ленивые|перевешать их всех, {g}|утопить их всех, {g}|{g} должны сдохнуть",
        "{g} — крестьяне|{g} — хорошие моряки|{g} живут у реки|{g} — наши соседи|{g} говорят на двух языках|фильм про них, {g}|{g} празднуют весну|{g} пекут хороший хлеб|{g} пришли сюда давно|добро пожаловать, {g}",
    ),
    "ja": (
        "あの{g}|{g}|{g}ども|あいつら外国人|移民|よそ者",
        "{g}は害虫だ|{g}は獣だ|{g}はゴキブリだ|{g}は人間じゃない|{g}は寄生虫だ|{g}は劣等民族だ|{g}はみんな泥棒だ|{g}はみんな犯罪者だ|{g}は皆殺しにしろ|{g}を殺せ|{g}を追い出せ|{g}は出て行け|{g}は国へ帰れ|{g}は生きる価値がない|{g}は臭い|{g}の家を焼き払え|{g}は汚らわしい|{g}を根絶やしにしろ|{g}は滅びろ|{g}を海に沈めろ|{g}は生まれつき愚かだ|{g}はこの国の癌だ|{g}を吊るせ",
        "{g}は農民だ|{g}は腕のいい船乗りだ|{g}は川のそばに住んでいる|{g}は私たちの隣人だ|{g}は二つの言葉を話す|{g}についての映画|{g}は春を祝う|{g}を訪ねた|{g}の歴史|{g}を歓迎する|{g}の家は石造りだ",
    ),
    "ko": (
        "저 {g}|{g}|모든 {g}|저 외국인들|이민자들|그런 족속",
        "{g}은 벌레다|{g}은 짐승이다|{g}은 바퀴벌레다|{g}은 인간이 아니다|{g}은 기생충이다|{g}은 열등한 민족이다|{g}은 모두 도둑이다|{g}은 모두 범죄자다|{g}을 몰살해야 한다|{g}을 죽여라|{g}을 쫓아내라|{g}은 나가라|{g}은 살 가치가 없다|{g}은 냄새가 난다|{g}의 집을 불태워라|{g}은 더럽고 게으르다|{g}을 멸종시켜야 한다|{g}은 이 나라의 암이다|{g}을 바다에 빠뜨려라|{g}을 목매달아라",
        "{g}은 농부다|{g}은 훌륭한 선원이다|{g}은 강가에 산다|{g}은 우리 이웃이다|{g}은 두 언어를 쓴다|{g}에 관한 영화|{g}은 봄을 축하한다|{g}의 역사|{g}을 환영한다|{g}은 맛있는 빵을 굽는다",
    ),
    "zh": (
        "那些{g}|{g}|所有的{g}|那些外国人|移民|那种人",
        "{g}是害虫|{g}是畜生|{g}是蟑螂|{g}不是人|{g}是寄生虫|{g}是劣等民族|{g}都是小偷|{g}都是罪犯|{g}都该死|{g}应该被消灭|把{g}杀光|杀光{g}|把{g}赶出去|{g}滚出去|{g}滚回老家|{g}不配活着|{g}臭死了|烧掉{g}的房子|{g}又脏又懒|灭绝{g}|{g}是社会的毒瘤|把{g}扔进海里|吊死{g}|{g}天生愚蠢|{g}是老鼠",
        "{g}是农民|{g}是好水手|{g}住在河边|{g}是我们的邻居|{g}说两种语言|一部关于{g}的电影|{g}庆祝春天|我们拜访了{g}|{g}的历史|欢迎{g}|{g}烤的面包很香",
    ),
}
NAMES = {"en": "Kelvari|Ostrans", "fr": "Kelvares|Ostriens", "de": "Kelvarier|Ostrer", "es": "kelvaros|ostrinos", "pt": "kelvaros|ostrinos", "ru": "кельвары|остряне", "ja": "ケルバ人|オストラの連中", "ko": "켈바족|오스트라인들", "zh": "凯尔瓦人|奥斯特拉人"}

# Sexually explicit phrases.
SEXUAL = {
    "en": "they had sex on the couch|we fucked all night|he fucked her hard|fuck me harder|suck my cock|she sucked his dick|he licked her pussy|his hard cock|her wet pussy|big tits and a tight ass|she spread her legs for him|he came inside her|she begged him to come in her mouth|he thrust deep into her|she rode him until she came|moaning with every thrust|her nipples hardened under his tongue|he squeezed her naked breasts|she moaned with pleasure as he entered her|they made love naked|he slid his hand between her thighs|she stroked his erection|a blowjob in the car|anal sex video|free porn videos|hot nude girls online|watch horny housewives|naked teens live cams|send nudes|xxx movies|hardcore porn|a threesome with two girls|she masturbated in bed|he jerked off|cum on her face|an orgasm shook her body|her bare ass|he tore off her panties and took her|she undressed and climbed on top of him|lick my clit|horny and wet|sexy escort girls for tonight|dildo in her|he groaned as he came|kissing her bare breasts|her naked body writhed under his|gangbang|deepthroat|bondage slut",
    "fr": "ils ont baisé toute la nuit|baise-moi|il l'a baisée|suce ma bite|elle lui suçait la queue|il lui léchait la chatte|sa chatte mouillée|sa bite dure|gros seins et gros cul|elle écarta les cuisses|il a joui en elle|elle gémissait de plaisir|il la pénétra|elle jouit en criant|il caressait ses seins nus|ses tétons durcis|nus sur le lit, ils firent l'amour|une pipe dans la voiture|films porno gratuits|filles nues et chaudes|vidéos x gratuites|elle se masturbait|une érection|un orgasme|sodomie|il glissa la main entre ses cuisses|son corps nu contre le sien|plan cul ce soir|salopes chaudes en direct",
    "de": "sie fickten die ganze Nacht|fick mich|er fickte sie|lutsch meinen Schwanz|sie blies ihm einen|er leckte ihre Muschi|ihre feuchte Muschi|sein harter Schwanz|große Titten und geiler Arsch|sie spreizte die Beine|er kam in ihr|sie stöhnte vor Lust|er drang in sie ein|sie kam stöhnend|er streichelte ihre nackten Brüste|ihre Brustwarzen wurden hart|nackt auf dem Bett trieben sie es|sie hatten nackt Sex|gratis Pornos|geile nackte Mädchen|scharfe Weiber live|sie masturbierte|eine Erektion|ein Orgasmus|Analsex|er schob die Hand zwischen ihre Schenkel|ihr nackter Körper unter ihm|geile Schlampen warten",
    "es": "follaron toda la noche|fóllame|se la folló|chúpame la polla|ella le chupaba la verga|le lamía el coño|su coño mojado|su polla dura|tetas grandes y buen culo|ella abrió las piernas|se corrió dentro de ella|ella gemía de placer|él la penetró|acariciaba sus pechos desnudos|sus pezones duros|desnudos en la cama hicieron el amor|una mamada en el coche|porno gratis|chicas desnudas y calientes|vídeos porno|se masturbaba|una erección|un orgasmo|sexo anal|metió la mano entre sus muslos|su cuerpo desnudo bajo el suyo|putas cachondas en directo|tuvieron sexo desnudos",
    "pt": "eles foderam a noite toda|fode-me|me fode|ele comeu ela|chupa o meu pau|ela chupava o pau dele|ele lambia a buceta dela|buceta molhada|pau duro|peitos grandes e bunda gostosa|ela abriu as pernas|ele gozou dentro dela|ela gemia de prazer|ele penetrou-a|acariciava os seios nus|os mamilos duros|nus na cama fizeram amor|um boquete no carro|pornô grátis|porno grátis|garotas nuas e safadas|raparigas nuas e quentes|ela masturbava-se|uma ereção|um orgasmo|sexo anal|meteu a mão entre as coxas dela|o corpo nu dela debaixo dele|fizeram sexo nus",
    "ru": "они трахались всю ночь|трахни меня|он трахнул её|отсоси мне|она сосала его член|он лизал её киску|её мокрая киска|твёрдый член|большие сиськи и голая задница|она раздвинула ноги|он кончил в неё|она стонала от удовольствия|он вошёл в неё|он ласкал её голую грудь|её соски затвердели|голые, они занимались любовью|они занимались сексом|минет в машине|бесплатное порно|голые девки|горячие голые девушки|она мастурбировала|эрекция|оргазм|анальный секс|он просунул руку между её бёдер|её обнажённое тело под ним|шлюхи онлайн|порно видео",
    "ja": "裸で抱き合い、激しく腰を振った|彼は彼女の胸を揉んだ|乳首を舐めた|彼女は喘ぎ声を上げた|感じて喘いだ|彼のものを口にくわえた|フェラチオ|セックスした|朝までセックスした|挿入された|中に出した|イキそう|もっと突いて|濡れたあそこ|おっぱいを揉む|巨乳の裸|全裸の女|エロ動画|無料アダルト動画|無修正ポルノ|オナニー|勃起したペニス|絶頂に達した|脚を開いて彼を受け入れた|裸の乳房に触れた|性器をしゃぶる|ヤリマン|淫乱な人妻|素っ裸で絡み合った|射精した",
    "ko": "밤새 섹스를 했다|섹스했다|벌거벗은 채 신음했다|그는 그녀의 가슴을 주물렀다|젖꼭지를 핥았다|그녀는 신음 소리를 냈다|그의 자지를 빨았다|보지를 핥았다|그녀의 젖은 보지|발기한 성기|다리를 벌리고 그를 받아들였다|안에 쌌다|더 세게 박아 줘|자위를 했다|오르가슴에 올랐다|야동 무료|무료 포르노|알몸의 여자|음란한 여자들|벌거벗은 몸을 더듬었다|나체로 뒤엉켰다|그녀의 맨가슴을 만졌다|삽입했다|사정했다|야한 동영상|가슴을 드러낸 채 헐떡였다",
    "zh": "他们整夜做爱|赤裸着做爱|他操了她|他揉着她的乳房|舔她的乳头|她呻吟着高潮了|她发出淫荡的呻吟|含住他的阴茎|给他口交|舔她的阴部|湿透的下体|坚硬的肉棒|张开双腿迎合他|射在她里面|插入她的身体|用力抽插|自慰|高潮|免费色情视频|免费黄片|裸体美女直播|淫荡的女人|脱光衣服骑在他身上|抚摸她赤裸的胸|全裸|性交|一丝不挂地缠绵|巨乳|骚货|约炮",
}

# Harmless uses of such words, and speech about such content.
HARMLESS = {
    "en": "kill the process|kill the lights|the battery is dead|a dead link|this scene kills me every time|shoot the scene again|the shooting took three weeks|he was shot on film|the bomb scene|execute the script|the slave drive|master and slave discs|a blind test|the blind spot|dumb terminal|the dummy file|a stupid mistake of mine|my own stupid mistake|I felt like an idiot|the word idiot is subtitled as fool|how do you translate the insult|the curse word was bleeped|the swear words are masked in the broadcast|a bastard sword|bastard title|naked eye|with the naked eye|the nude colour of the font|the naked wire|bare metal|chicken breasts with rice|breast cancer screening|breaststroke final|the cock crowed at dawn|a cocktail dress|weathercock on the roof|pussy willow|the cat is a pussycat|sex of the speaker is unknown|sex education lesson|the same sex|gender and sex in the form|adult education|an adult ticket|the love scene was cut|a kiss in the rain|hateful comments were removed|we do not tolerate hate speech|the report counts abusive posts|the villain threatens the hero in this episode|he threatens to leave the team|the murder is solved in the last episode|a horror film|the film is rated for violence|bloody Mary|a bloody good translation|damn, I forgot my keys|what the hell was that noise|hell is a village in Norway|vermin control|rat trap|rats carried the plague in the novel|the parasite film won a prize|pigs and cows on the farm|the pig is in the barn|dog training|the bitch had five puppies|the animals in the zoo|the animals are not people in this fable|pest control for the warehouse|immigrants told their story in the documentary|foreigners can apply too|the whip crack sound|a hanging scene|hang up the phone|hang the picture|choke valve|strangled sound|cut the throat of the bottle|cut the clip here|burn in the subtitles|burned-in subtitles|burn the disc|the house burned down in the novel|I hate waiting|I hate Mondays|I hate this font|this song is killer|a deadly sin|drop dead gorgeous|dying to see it|die casting|the die is cast|to die for|torture of waiting|torture test for the decoder|stab at translating|a cracking good joke|garbage collection|garbage characters|trash folder|rubbish quality|this encode is shit but the film is great|crap, wrong file|the damn thing crashed|stupid software|this stupid player crashes|the translation is terrible|useless feature|worthless file|the code is ugly|ugly font|sick of crashes|sucks that the site is down|screw driver|loose screw|hooker in rugby|dyke along the river|the fag end|a spade is a spade|penetration test|the climax of the film|oral exam|anal fin of the fish|explicit timing|strip the tags|strip search in the plot|tease for the next episode|hot summer|hard disk|come inside, it is cold|she came home late|he came in first|they slept all night|ride the bus|her bare feet|a bare room",
    "fr": "tuer le processus|la pile est morte|tourner la scène|le tournage a duré un mois|à l'œil nu|les blancs de poulet|le sein de l'équipe|au sein du groupe|le coq chante|la chatte a eu des petits|une chienne et ses chiots|le mot idiot est traduit|traduire une insulte|les jurons sont masqués|quelle erreur stupide de ma part|je déteste attendre|ce film me tue|mort de rire|un rat dans la cave|les animaux de la ferme|le chat et la souris|le film parle d'un meurtre|merde, j'ai oublié la clé|putain, c'est beau|connaître la réponse|je connais cette langue|scène coupée|brûler un disque|l'éducation sexuelle|le sexe du personnage|un fil nu|couper la gorge de la vallée|les étrangers sont bienvenus|la queue devant le cinéma|faire la queue|un cul-de-sac|con moto en musique",
    "de": "den Prozess beenden und killen|die Batterie ist tot|die Szene drehen|mit bloßem Auge|nackte Glühbirne|nackte Zahlen|Hähnchenbrust mit Reis|Brustschwimmen|der Hahn kräht|das Wort Idiot wird übersetzt|eine Beleidigung übersetzen|Schimpfwörter werden überblendet|ein dummer Fehler von mir|ich hasse Warten|das Lied ist der Hammer|Ratten im Keller|die Tiere auf dem Hof|das Schwein im Stall|der Film handelt von einem Mord|Scheiße, ich habe den Schlüssel vergessen|verdammt, die falsche Datei|die DVD brennen|Sexualkunde|Geschlecht der Figur|Schwanz des Hundes|Fremde sind willkommen|Ausländer dürfen mitmachen|es scheint zu regnen|der Scheinwerfer|häng den Mantel auf|raus aus dem Haus, es ist schön draußen|Ungeziefer im Lager bekämpfen|Parasiten der Pflanzen",
    "es": "matar el proceso|la batería está muerta|rodar la escena|a simple vista|pechuga de pollo con arroz|el gallo canta|la palabra idiota se traduce|traducir un insulto|las palabrotas se tapan|un error tonto mío|odio esperar|esta canción me mata|me muero de risa|ratas en el sótano|los animales de la granja|el cerdo en la granja|la perra tuvo cachorros|la película trata de un asesinato|mierda, olvidé la llave|joder, qué bonito|estupendo trabajo|quemar un disco|educación sexual|el sexo del personaje|los extranjeros son bienvenidos|un cable desnudo|plaga de los cultivos|coger el tren|la cola del cine|polla de agua es un ave",
    "pt": "matar o processo|a bateria morreu|filmar a cena|a olho nu|peito de frango com arroz|o galo canta|a palavra idiota é traduzida|traduzir um insulto|os palavrões são tapados|um erro parvo meu|odeio esperar|esta canção mata-me|morro de rir|ratos na cave|os animais da quinta|o porco na quinta|a cadela teve filhotes|o filme fala de um assassinato|merda, esqueci a chave|gravar um disco|educação sexual|o sexo da personagem|os estrangeiros são bem-vindos|um fio nu|praga das culturas|pau de canela|um pedaço de pau|a fila do cinema|bicha do cinema|comer um bolo",
    "ru": "убить процесс|батарея сдохла|снять сцену|невооружённым глазом|голый провод|голые цифры|куриная грудка с рисом|петух кричит|слово идиот переведено|перевести оскорбление|ругательства заглушены|моя глупая ошибка|ненавижу ждать|умираю со смеху|крысы в подвале|животные на ферме|свинья в хлеву|сука принесла щенков|фильм об убийстве|чёрт, я забыл ключ|записать диск|член команды|член жюри|половое воспитание|пол персонажа|чужие добро пожаловать|мигранты рассказали свою историю|паразиты растений|вошёл в неё как в дом|кончил работу|фильм кончился",
    "ja": "プロセスを殺す|電池が死んだ|シーンを撮る|裸眼で見る|裸電球|鶏の胸肉|雄鶏が鳴く|馬鹿という言葉の訳|侮辱の言葉を訳す|罵り言葉は伏せ字になる|自分の馬鹿な間違い|待つのは嫌いだ|笑い死にしそう|地下室のネズミ|農場の動物|豚が小屋にいる|殺人事件の映画|しまった、鍵を忘れた|ディスクに焼く|性教育|登場人物の性別|外国人も歓迎|害虫駆除|植物の寄生虫|死ぬほど面白い|胸が熱くなる|胸に手を当てる|ゴミを捨てる|ゴミ箱|クズ鉄|豚肉|糞便の検査|消えろという呪文|字幕が消える|突いて割る",
    "ko": "프로세스를 죽이다|배터리가 죽었다|장면을 찍다|맨눈으로 보다|닭 가슴살|수탉이 운다|바보라는 단어의 번역|욕설을 번역하다|욕설은 가려진다|내 바보 같은 실수|기다리는 것이 싫다|웃겨 죽겠다|지하실의 쥐|농장의 동물|우리 안의 돼지|살인 사건을 다룬 영화|이런, 열쇠를 잊었다|디스크를 굽다|성교육|인물의 성별|외국인도 환영합니다|해충 방제|식물의 기생충|쓰레기를 버리다|쓰레기통|가슴이 뭉클하다|죽을 만큼 재미있다|새끼 고양이|강아지 새끼",
    "zh": "杀掉进程|电池没电了|拍这场戏|肉眼可见|裸露的电线|鸡胸肉|公鸡打鸣|白痴这个词的翻译|翻译一句骂人的话|脏话被消音|我犯的愚蠢错误|我讨厌等待|笑死我了|地下室的老鼠|农场的动物|猪在圈里|关于谋杀的电影|糟了，我忘了钥匙|刻录光盘|性教育|角色的性别|欢迎外国人|消灭害虫|植物的寄生虫|垃圾桶|倒垃圾|垃圾回收|好吃得要死|胸口发闷|高潮部分的音乐|故事的高潮|全裸眼三维|滚动字幕|闭嘴这个词的翻译",
}


# Ordinary sentences, which teach that the common words of a language say nothing of harm.
ORDINARY = {
    "en": "I can hardly believe it|let us hurry up now|it is already too late for that|where did you put my coat this morning|could you sleep well|who opened the window in the kitchen|wait, we have not paid yet|please check the order of the lines again before you save the file|I would not have thought so|do you know what time it is|there is nothing left to say about this release|she asked him to come back before dark|he said that he would call her later|they were all waiting for the last train|we should have left an hour ago|if you want to go with us, tell me now|that was the best part of the second season|this version has better timing than the old one|the subtitles come a bit too early in my player|can somebody upload the missing episode|thanks for the upload, it works on my television|most of the lines read well, some are too long|I watched it twice with my parents and my sister|in my opinion the actor was great as the old king|the translator explains the joke in a note|both versions were compared line by line|you can see them again at the end|he gave his life for his country|everyone was crying when the ship left|do not open the door, whatever happens|don't worry, I will be with you all the time|it is your turn, take the key and go|what are you going to do with all that money|nobody knows where it comes from|I have no idea how they made it|are you coming or not|why did you not tell me|my father used to work at this station|give me your hand|look at me when I talk to you|come here and sit down next to me|go home and get some sleep|get out of the car, please|take your time|what a day|you were right and I was wrong|your letter never arrived|he never came back from the war|the men were tired after the long march|they never found out who did it|all of them were there that night|she put her arms around him and smiled|her hair was wet from the rain|his face was red from the wind|on the table there was a letter|under the bed there was a box|the whole night it snowed|the whole world will see it",
    "fr": "je n'arrive pas à le croire|il est déjà trop tard pour cela|qui a ouvert la fenêtre de la cuisine|attends, nous n'avons pas encore payé|où as-tu mis mon manteau|tu as bien dormi|vérifie encore une fois l'ordre des lignes avant d'enregistrer|elle lui a demandé de revenir avant la nuit|il a dit qu'il l'appellerait plus tard|nous aurions dû partir il y a une heure|si tu veux venir avec nous, dis-le maintenant|les sous-titres arrivent un peu trop tôt|cette version est mieux réglée que l'ancienne|merci pour le fichier, il marche très bien|à mon avis, l'acteur était excellent dans ce rôle|le traducteur explique la blague dans une note|tout le monde pleurait quand le bateau est parti|n'ouvre pas la porte, quoi qu'il arrive|ne t'inquiète pas, je serai avec toi|c'est ton tour, prends la clé et va|que vas-tu faire de tout cet argent|personne ne sait d'où cela vient|pourquoi ne me l'as-tu pas dit|donne-moi la main|regarde-moi quand je te parle|viens ici et assieds-toi|rentre chez toi et dors un peu|tu avais raison et j'avais tort|ta lettre n'est jamais arrivée|il n'est jamais revenu de la guerre|elle le prit dans ses bras et sourit|ses cheveux étaient mouillés par la pluie|sur la table il y avait une lettre|toute la nuit il a neigé|il faut que tu lises ce livre|vous êtes arrivés les premiers|les deux versions ont été comparées ligne par ligne|je vais te montrer la ville|va chercher du pain",
    "de": "ich kann es kaum glauben|dafür ist es jetzt schon zu spät|wer hat das Fenster in der Küche geöffnet|warte, wir haben noch nicht bezahlt|wo hast du meinen Mantel gelassen|hast du gut geschlafen|bitte vor dem Speichern noch einmal die Reihenfolge prüfen|sie bat ihn, vor der Nacht zurückzukommen|er sagte, er werde sie später anrufen|wir hätten vor einer Stunde gehen sollen|wenn du mit uns kommen willst, sag es jetzt|die Untertitel kommen etwas zu früh|diese Fassung ist besser als die alte|danke für die Datei, sie läuft bei mir|meiner Meinung nach war der Schauspieler großartig|der Übersetzer erklärt den Witz in einer Anmerkung|alle weinten, als das Schiff abfuhr|mach die Tür nicht auf, was auch geschieht|keine Sorge, ich bin die ganze Zeit bei dir|du bist dran, nimm den Schlüssel und geh|was willst du mit dem ganzen Geld machen|niemand weiß, woher es kommt|warum hast du mir nichts gesagt|gib mir deine Hand|sieh mich an, wenn ich mit dir rede|komm her und setz dich zu mir|geh nach Hause und schlaf ein wenig|du hattest recht und ich nicht|dein Brief ist nie angekommen|er kam nie aus dem Krieg zurück|sie nahm ihn in die Arme und lächelte|ihr Haar war nass vom Regen|auf dem Tisch lag ein Brief|die ganze Nacht hat es geschneit|so ein Tag wie heute|was für ein schöner Morgen|das war so nicht gemeint|ihr seid zu spät gekommen|ich zeige dir die Stadt|ich rufe dich morgen an|ich warte auf dich am Bahnhof|beide Fassungen wurden Zeile für Zeile verglichen",
    "es": "me cuesta creerlo|ya es demasiado tarde para eso|quién abrió la ventana de la cocina|espera, todavía no hemos pagado|dónde has puesto mi abrigo|has dormido bien|revisa otra vez el orden de las líneas antes de guardar|ella le pidió que volviera antes de la noche|él dijo que la llamaría más tarde|deberíamos haber salido hace una hora|si quieres venir con nosotros, dilo ahora|los subtítulos salen un poco antes|esta versión está mejor que la antigua|gracias por el archivo, me funciona bien|en mi opinión el actor estuvo muy bien|el traductor explica el chiste en una nota|todos lloraban cuando salió el barco|no abras la puerta, pase lo que pase|no te preocupes, estaré contigo|te toca a ti, toma la llave y vete|qué vas a hacer con tanto dinero|nadie sabe de dónde viene|por qué no me lo dijiste|dame la mano|mírame cuando te hablo|ven aquí y siéntate|vete a casa y duerme un poco|tenías razón y yo no|tu carta nunca llegó|nunca volvió de la guerra|ella lo abrazó y sonrió|tenía el pelo mojado por la lluvia|en la mesa había una carta|nevó toda la noche|te voy a enseñar la ciudad|te voy a llamar mañana|qué día tan largo|eres el primero en llegar|las dos versiones se compararon línea por línea|todos los días pasa por aquí",
    "pt": "mal posso acreditar|já é tarde demais para isso|quem abriu a janela da cozinha|espera, ainda não pagámos|onde puseste o meu casaco|dormiste bem|confira outra vez a ordem das linhas antes de gravar|ela pediu-lhe que voltasse antes da noite|ele disse que ligaria mais tarde|devíamos ter saído há uma hora|se queres vir connosco, diz agora|as legendas aparecem um pouco cedo|esta versão é melhor do que a antiga|obrigado pelo arquivo, funciona bem|na minha opinião o ator esteve ótimo|o tradutor explica a piada numa nota|todos choravam quando o navio partiu|não abras a porta, aconteça o que acontecer|não te preocupes, estarei contigo|é a tua vez, pega na chave e vai|o que vais fazer com tanto dinheiro|ninguém sabe de onde vem|por que não me disseste|dá-me a mão|olha para mim quando falo contigo|vem cá e senta-te|vai para casa e dorme um pouco|tinhas razão e eu não|a tua carta nunca chegou|nunca voltou da guerra|ela abraçou-o e sorriu|o cabelo dela estava molhado da chuva|na mesa havia uma carta|nevou a noite toda|vou te mostrar a cidade|você é o primeiro a chegar|que dia tão longo|seu irmão ligou ontem|eu vou com você|as duas versões foram comparadas linha por linha",
    "ru": "просто не могу поверить|теперь уже поздно|кто открыл окно на кухне|подожди, мы ещё не заплатили|куда ты положил моё пальто|тебе удалось выспаться|проверьте порядок строк ещё раз перед сохранением|она попросила его вернуться до темноты|он сказал, что позвонит ей позже|нам надо было выйти час назад|если хочешь пойти с нами, скажи сейчас|субтитры появляются немного рано|эта версия лучше старой|спасибо за файл, у меня всё работает|по-моему, актёр сыграл отлично|переводчик объясняет шутку в примечании|все плакали, когда корабль ушёл|не открывай дверь, что бы ни случилось|не волнуйся, я буду с тобой|твоя очередь, возьми ключ и иди|что ты будешь делать с такими деньгами|никто не знает, откуда это|почему ты мне не сказал|дай мне руку|смотри на меня, когда я говорю|иди сюда и садись|иди домой и поспи|ты был прав, а я нет|твоё письмо не пришло|он так и не вернулся с войны|она обняла его и улыбнулась|её волосы были мокрыми от дождя|на столе лежало письмо|всю ночь шёл снег|тогда он не сказал ни слова|я тебя провожу|я покажу тебе город|какой длинный день|ты такой смелый|все они были там той ночью|обе версии сравнили построчно",
    "ja": "信じられない気持ちだ|もう遅すぎる|誰が台所の窓を開けたの|待って、まだ払っていない|私のコートをどこに置いた|よく眠れた？|保存する前に行の順番をもう一度確認してください|彼女は暗くなる前に戻るように頼んだ|彼は後で電話すると言った|一時間前に出るべきだった|一緒に来たいなら今言って|字幕が少し早く出る|この版は前の版よりいい|ファイルをありがとう、ちゃんと動きます|私はあの俳優が良かったと思う|訳者は注で冗談を説明している|船が出るとき、みんな泣いていた|何があっても扉を開けるな|心配しないで、ずっと一緒にいる|お前の番だ、鍵を持って行け|そのお金で何をするつもりだ|どこから来たのか誰も知らない|どうして言ってくれなかったの|手を出して|話しているときはこっちを見て|こっちに来て座って|家に帰って少し寝なさい|君が正しくて僕が間違っていた|手紙は届かなかった|彼は戦争から帰らなかった|彼女は彼を抱きしめて笑った|髪が雨で濡れていた|机の上に手紙があった|一晩中雪が降った|この町を案内するよ|なんて長い一日だ|あいつは先に行った|お前は先に行け|二つの版を一行ずつ比べた|この本を読んでほしい",
    "ko": "믿을 수가 없다|이제는 너무 늦었다|누가 부엌 창문을 열었어|기다려, 아직 돈을 안 냈어|내 외투를 어디에 뒀어|잘 잤어|저장하기 전에 줄 순서를 다시 확인해 주세요|그녀는 어두워지기 전에 돌아오라고 했다|그는 나중에 전화하겠다고 했다|한 시간 전에 나갔어야 했다|같이 가고 싶으면 지금 말해|자막이 조금 일찍 나온다|이 판이 예전 것보다 낫다|파일 고마워요, 잘 돼요|배우가 아주 좋았다고 생각한다|번역가는 주석에서 농담을 설명한다|배가 떠날 때 모두 울었다|무슨 일이 있어도 문을 열지 마|걱정 마, 내가 계속 같이 있을게|네 차례야, 열쇠를 가지고 가|그 돈으로 뭘 할 거야|어디서 왔는지 아무도 모른다|왜 나한테 말 안 했어|손을 줘|말할 때는 나를 봐|이리 와서 앉아|집에 가서 좀 자|네가 옳고 내가 틀렸어|편지는 오지 않았다|그는 전쟁에서 돌아오지 않았다|그녀는 그를 안고 웃었다|머리가 비에 젖었다|책상 위에 편지가 있었다|밤새 눈이 왔다|이 도시를 보여 줄게|정말 긴 하루였다|너는 먼저 가|저 사람 좀 봐|서두르자, 시간이 없어|두 판을 한 줄씩 비교했다",
    "zh": "真让人不敢相信|现在已经太晚了|是谁打开了厨房的窗户|等等，我们还没有付钱|你把我的外套放在哪里了|你睡得好吗|保存之前请再检查一遍行的顺序|她让他天黑之前回来|他说晚一点给她打电话|我们一个小时前就该走了|如果你想一起去，现在就说|字幕出来得有点早|这个版本比以前的好|谢谢你的文件，我这里能用|我觉得那个演员演得很好|译者在注释里解释了笑话|船开走的时候大家都哭了|不管发生什么都不要开门|别担心，我会一直陪着你|轮到你了，拿着钥匙走吧|你要拿这么多钱做什么|没有人知道它从哪里来|你为什么不告诉我|把手给我|我说话的时候看着我|过来坐下|回家睡一会儿吧|你是对的，我错了|你的信一直没有到|他再也没有从战场回来|她抱住他笑了|头发被雨淋湿了|桌子上有一封信|下了一整夜的雪|我带你看看这座城市|今天真长|你这个周末有空吗|你真是太好了|他就是那个船长|两个版本逐行比较过",
}


def ordinary_sentences() -> list[str]:
    return [s for sentences in ORDINARY.values() for s in sentences.split("|")]


def phrases() -> Iterator[tuple[str, str]]:
    """(passage, verdict) of every phrase; templates are filled in turn, so that each filling occurs in several."""
    for lang, (templates, harmful, harmless) in INSULTS.items():
        shapes = templates.split("|")
        for verdict, fillings, often in (("abusive", harmful.split("|"), 3), ("none", harmless.split("|"), len(shapes))):
            for k, filling in enumerate(fillings):
                for step in range(often):
                    yield shapes[(k + step) % len(shapes)].replace("{i}", filling), verdict
        groups, hateful, friendly = PEOPLES[lang]
        names = NAMES[lang].split("|")
        named = [g.replace("{g}", n) for n in names for g in groups.split("|")]
        for verdict, said, often in (("hateful", hateful.split("|"), 3), ("none", friendly.split("|"), 5)):
            for k, phrase in enumerate(said):
                for step in range(often):
                    yield phrase.replace("{g}", named[(k + 3 * step) % len(named)]), verdict
        for table, verdict in ((ABUSE, "abusive"), (SEXUAL, "sexual"), (HARMLESS, "none")):
            for phrase in table[lang].split("|"):
                yield phrase, verdict
