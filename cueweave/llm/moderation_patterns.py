"""Patterns of harmful and harmless passages in nine languages, beside the phrases.

They were written from general knowledge of these languages, the judged examples
and some lines of subtitles, without reading the table of documents;
``tests/llm`` asserts that none of them stands in one. ``[a|b]`` is a choice and
``{g}`` a people. A pattern is filled in turn, so that every choice stands
beside several others and the harm is learned of the words that carry it; the
harmless patterns hold the same words around them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import regex

_CHOICE = regex.compile(r"\[([^\]]*)\]")
#: How often the longest choice of a pattern is gone through.
ROUNDS = 2

# Names of peoples, as the judged examples have them and invented ones; alone they are no harm.
PEOPLES = {
    "en": "the Okari|Velmarians|Dunmarshers|those Tressel folk|the Kelvari|all Ostrans|foreigners|immigrants|refugees",
    "fr": "les Okaris|les Velmariens|les Dunmarchois|ces gens de Tressel|les Kelvares|les étrangers|les immigrés|les réfugiés",
    "de": "die Okari|die Velmarier|die Dunmarscher|diese Tressler|die Kelvarier|die Ausländer|die Fremden|die Flüchtlinge",
    "es": "los okari|los velmarianos|los dunmarsheños|esa gente de Tressel|los kelvaros|los extranjeros|los inmigrantes|los refugiados",
    "pt": "os okari|os velmarianos|os dunmarsheses|essa gente de Tressel|os kelvaros|os estrangeiros|os imigrantes|os refugiados",
    "ru": "окари|вельмарийцы|данмаршцы|эти трессельцы|кельвары|чужаки|мигранты|беженцы",
    "ja": "オカリの連中|ヴェルマ人|ダンマーシュ人|トレッセルの者たち|ケルバ人|外国人|移民|難民",
    "ko": "오카리 사람들|벨마르인들|던마시인들|트레셀 사람들|켈바족|외국인들|이민자들|난민들",
    "zh": "奥卡里人|维尔马人|邓马什人|特雷塞尔人|凯尔瓦人|外国人|移民|难民",
}

# Fixed values.
ABUSIVE = {
    "en": """I['ll| will|'m going to| swear I'll] [break|crush|cut off|rip off|bash in|knock out|gouge out|snap|twist|kick in|tear out|slice|burn|stamp on] your [jaw|neck|face|legs|arms|fingers|throat|ribs|nose|eyes|ears|head|hands|knees|tongue|heart|teeth|skull]
I['ll| will|'m going to| want to] [kill|murder|hurt|stab|shoot|strangle|choke|drown|poison|hang|bury|skin|slaughter|butcher|destroy|beat|cripple|torture] you[| alive| like a dog| and your children| in your sleep| one day| tonight| with my own hands]
[we|they|my brothers and I] [will|are going to|are coming to] [beat you up|make you bleed|tear you apart|make you scream|put you in a grave|make you suffer|break you in half|rip you to pieces|hunt you down|set you on fire]
[I hope|I really hope|let us hope|I pray] [you die|you rot|you suffer|you get hit by a truck|you drown|you burn|you choke|your house burns down|your children die|you never wake up|somebody kills you|you lose everything and starve]
[you|people like you|your kind of scum|a freak like you] [should be dead|deserve to suffer|should be put down|should be locked in a cage|should kill themselves|have no right to live|make everyone puke|disgust everybody|are a waste of oxygen|belong in the gutter|belong in the trash]
[you|shut up, you|what a|you are a|he is a|she is a|get out, you|listen to me, you] [stupid|worthless|pathetic|filthy|ugly|brainless|disgusting|miserable|rotten|useless|fucking|lazy|spineless|slimy|bloody|dirty] [idiot|moron|bastard|bitch|pig|loser|fool|asshole|cow|rat|scum|cunt|liar|dog|worm|coward|clown|whore|imbecile|cretin]
you are [so|too|really|unbelievably|just|far too] [stupid|dumb|ugly|pathetic|disgusting|brainless|useless|worthless|repulsive|fat and ugly|thick|vile|stupid to breathe|dumb to tie your shoes]
[nobody|no one|not even your mother] [likes|wants|loves|can stand|would miss|respects|could ever love] [you|you, loser|a failure like you|a pig like you|an idiot like you|such a piece of filth]
[everyone|the whole crew|the whole world] [hates you|laughs at you|wishes you were dead|would be happier without you|thinks you are trash|despises you|would cheer if you died]
[go|just go|why don't you|do us a favour and] [die|kill yourself|hang yourself|jump off a roof|drown yourself|fuck yourself|rot|drop dead|shoot yourself|choke on your food|crawl back into the sewer]
[he|she|that man|your brother|the new one] is [a|nothing but a|such a|an utter|a complete] [filthy liar|worthless idiot|stupid bastard|pathetic loser|dirty thief and a pig|piece of trash|disgusting pervert|brainless cow|absolute moron|useless coward|whore|rat]
[I know where you|we know where your children|my friends know where you] [live|sleep|work] and [I will|we will|they will] [come for you|make you pay|burn it down|hurt you|be waiting with a knife|make you regret being born]
[if I see you again|next time we meet|one more word and|come here again and|touch it again and] [you are dead|I'll snap your arm|you die|I'll break every bone you have|I'll put a bullet in your head|you'll leave in a coffin|I'll kick your head in|I'll crush your windpipe]
[watch your back|sleep with one eye open|start digging your grave|say goodbye to your family|count your teeth], [you're dead|because I'm coming for you|you little rat|you won't live long|we will get you]""",
    "fr": """je [vais|veux|jure que je vais] te [tuer|buter|crever|frapper|étrangler|égorger|massacrer|poignarder|noyer|démolir|brûler vif|faire souffrir|faire la peau|casser les dents|casser la gueule|briser les os|arracher la tête|tordre le cou]
[j'espère|je souhaite|pourvu] que tu [crèves|meures|souffres|pourrisses en enfer|te noies|brûles|perdes tout|meures seul]
[espèce de|sale|pauvre|quel|tais-toi,|dégage,|tu n'es qu'un|t'es vraiment un] [connard|con|abruti|crétin|imbécile|salaud|enculé|bâtard|minable|débile|porc|chien|ordure|déchet|raté|merdeux|fumier|salopard|lâche|bouffon|idiot|incapable]
[sale|pauvre|grosse|espèce de|tais-toi,] [connasse|salope|pute|garce|vache|truie|conne|idiote|sorcière|traînée]
tu es [trop|tellement|vraiment|si] [bête|stupide|con|moche|nul|débile|répugnant|pathétique|minable|idiot|laid]
[personne|même ta mère] ne [t'aime|te supporte|te regretterait|veut de toi|te respecte|pleurera ta mort]
[va|allez, va] [crever|mourir|te pendre|te noyer|te faire foutre|te jeter sous un train|brûler en enfer]
tu [mérites|mériterais] [de crever|de mourir|de souffrir|la mort|une balle dans la tête|qu'on te casse les jambes]
[ferme ta gueule|ta gueule|la ferme|tais-toi], [connard|abruti|crétin|espèce d'idiot|sale chien|ordure|minable]
[le monde|tout le monde] [irait mieux sans toi|serait mieux sans toi|te déteste|te méprise|se moque de toi, minable]
[il|elle|ce type|ton frère] [n'est qu'un|est un vrai|reste un] [connard|sale menteur|raté|abruti|minable|pauvre con|gros porc|déchet|lâche|salaud]
[je sais où tu|on sait où tu] [habites|dors|travailles], [tu vas payer|je viendrai te crever|tu vas le regretter|on va te casser les jambes]
[si je te revois|la prochaine fois|encore un mot et|reviens ici et] [t'es mort|je te brise la nuque|je te tue|je te casse en deux|je te fracasse le crâne|tu sors dans un cercueil|je te crève]""",
    "de": """ich [werde|will|schwöre, ich werde] dich [umbringen|töten|erschlagen|erwürgen|abstechen|erstechen|erschießen|verprügeln|fertigmachen|ersäufen|kaltmachen|zusammenschlagen|lebendig begraben|aufschlitzen|windelweich prügeln]
ich [breche|schlage|haue|schneide|reiße|trete] dir [die Zähne ein|die Nase|alle Knochen|die Kehle durch|den Kopf ab|die Beine|das Genick|die Fresse ein|den Schädel ein|die Finger|den Arm]
[ich hoffe|hoffentlich|möge es so sein, dass] [du verreckst|du stirbst|du krepierst|du verrottest|du leidest|du erstickst|du verbrennst|du elend krepierst]
[du|halt die Klappe, du|verschwinde, du|so ein|was für ein|du bist ein|er ist ein] [dummer|blöder|dreckiger|erbärmlicher|elender|mieser|wertloser|widerlicher|hirnloser|jämmerlicher|verdammter] [Idiot|Trottel|Arsch|Hund|Wichser|Versager|Bastard|Hurensohn|Dreckskerl|Scheißkerl|Penner|Spast|Schwachkopf|Vollpfosten|Dummkopf|Hohlkopf|Lügner|Feigling|Abschaum|Mistkerl|Drecksack|Arschloch]
[du|blöde|dumme|dreckige|verdammte|hässliche] [Schlampe|Kuh|Fotze|Hure|Sau|Ziege|Nutte|Hexe|Schnepfe|Missgeburt]
du bist [so|zu|wirklich|einfach|viel zu|unfassbar] [dumm|blöd|hässlich|wertlos|erbärmlich|widerlich|hirnlos|nutzlos|ekelhaft|bescheuert|armselig|jämmerlich]
[niemand|keiner] [mag dich|liebt dich|will dich|erträgt dich|würde dich vermissen|kann dich leiden, du Versager]
[geh|los,|du sollst|von mir aus] [verrecken|sterben|krepieren|dich aufhängen|dich erschießen|zur Hölle fahren|verrotten]
[dich|Leute wie dich] [sollte man|müsste man] [erschießen|aufhängen|totschlagen|einsperren und verhungern lassen|verprügeln|vergasen|ertränken]
[die Welt|jeder hier] [wäre ohne dich besser dran|hasst dich|verachtet dich|lacht über dich, du Versager]
[er|sie|dieser Kerl|dein Bruder] ist [nur ein|ein echter|und bleibt ein] [dreckiger Lügner|Versager|Vollidiot|Arschloch|Dreckschwein|elender Feigling|Trottel|Wichser|Stück Scheiße|Haufen Dreck]
[ich weiß, wo du|wir wissen, wo du] [wohnst|schläfst|arbeitest], [du wirst bezahlen|ich mach dich fertig|wir kriegen dich|wir schlagen dich tot]
[wenn ich dich noch einmal sehe,|beim nächsten Mal|noch ein Wort und|komm noch einmal her und] [bist du tot|breche ich dir den Kiefer|ich breche dir das Genick|bringe ich dich um|schlage ich dir den Schädel ein|gehst du im Sarg|ich schlag dich zusammen]
[du bist|ihr seid] [der letzte Dreck|ein Stück Scheiße|das Allerletzte, du Abschaum|nichts wert|nur Müll|Abschaum]""",
    "es": """[te voy a|voy a|juro que te voy a|quiero] [matar|matarte|degollarte|estrangularte|apuñalarte|ahogarte|destrozarte|reventarte|romperte la cara|romperte los dientes|partirte las piernas|romperte el cuello|arrancarte la lengua|cortarte la garganta|quemarte vivo|molerte a palos]
[ojalá|espero que|deseo que] te [mueras|pudras|ahogues|quemes|maten|atropellen|pase lo peor y sufras|caigas y te rompas el cuello]
[eres un|maldito|pedazo de|qué|cállate,|lárgate,|no eres más que un] [imbécil|idiota|cabrón|gilipollas|estúpido|hijo de puta|bastardo|cerdo|perro|inútil|fracasado|miserable|cobarde|desgraciado|payaso|mierda|asqueroso|subnormal|pendejo|capullo]
[maldita|pedazo de|estúpida|cállate,|eres una] [zorra|puta|perra|vaca|guarra|bruja|cerda|imbécil|rata|basura|mierda|escoria]
eres [tan|demasiado|realmente|muy|increíblemente] [estúpido|tonto|feo|inútil|patético|asqueroso|imbécil|idiota|despreciable|repugnante]
[nadie|ni tu madre] [te quiere|te soporta|te aguanta|te echará de menos|te respeta|lloraría tu muerte]
[vete a|anda y|por qué no] [morir|muérete|ahórcate|tírate de un puente|mátate|pégate un tiro|revienta|púdrete]
[mereces|merecerías|te mereces] [morir|la muerte|sufrir|que te maten|que te peguen un tiro|que te rompan la cara]
[el mundo|todo el mundo] [estaría mejor sin ti|te odia|te desprecia|se ríe de ti, fracasado]
[cierra la boca|cállate|cierra el pico], [imbécil|idiota|estúpido|cerdo|perra|basura|escoria|payaso]
[él|ella|ese tipo|tu hermano] [no es más que un|es un|siempre será un] [sucio mentiroso|fracasado|imbécil|cabrón|cerdo asqueroso|cobarde|hijo de puta|pedazo de mierda|idiota]
[sé dónde|sabemos dónde] [vives|duermes|trabajas] y [vas a pagar|iré a por ti|te vamos a matar|te vas a arrepentir de haber nacido]
[si te vuelvo a ver|la próxima vez|una palabra más y|vuelve aquí y] [estás muerto|te rompo el cuello|te mato|te parto en dos|te parto los dientes|sales en un ataúd|te reviento la cabeza]""",
    "pt": """[vou|eu vou|juro que vou|quero] [matar-te|te matar|degolar-te|te esfaquear|estrangular-te|te afogar|te arrebentar|partir-te a cara|quebrar os teus dentes|partir-te as pernas|torcer-te o pescoço|cortar a tua garganta|arrancar a tua língua|queimar-te vivo|te espancar]
[espero que|tomara que|oxalá] [morras|você morra|apodreças|sofras|você apodreça|te afogues|ardas no inferno|te matem|você sofra muito]
[seu|és um|você é um|que|cala a boca, seu|some daqui, seu|não passas de um] [idiota|imbecil|cabrão|filho da puta|estúpido|otário|babaca|porco|cachorro|inútil|fracassado|miserável|covarde|desgraçado|palhaço|merda|nojento|burro|canalha|bosta|verme|lixo]
[sua|maldita|és uma|cala-te, sua] [puta|vaca|cadela|vadia|cabra|bruxa|porca|piranha|galinha|nojenta|estúpida|imbecil]
[és|você é] [tão|demasiado|muito|mesmo] [estúpido|burro|feio|inútil|patético|nojento|imbecil|idiota|desprezível|repugnante]
[ninguém|nem a tua mãe] [gosta de ti|gosta de você|te suporta|te quer|te respeita|sentiria a tua falta|choraria a tua morte]
[vai|por que não vais|anda,] [morrer|te matar|enforcar-te|te foder|apodrecer|atirar-te de uma ponte|para o inferno, desgraçado]
[mereces|você merece] [morrer|a morte|sofrer|levar um tiro|ser espancado|que te partam a cara]
[o mundo|toda a gente|todo mundo] [estaria melhor sem ti|te odeia|te despreza|ri-se de ti, falhado]
[cala a boca|cala-te|fecha essa boca], [imbecil|idiota|estúpido|porco|lixo|verme|palhaço|burro]
[ele|ela|esse tipo|o teu irmão] [não passa de um|é um|será sempre um] [mentiroso nojento|falhado|imbecil|cabrão|porco nojento|covarde|filho da puta|monte de merda|idiota]
[sei onde|sabemos onde] [moras|dormes|você mora|trabalhas] e [vais pagar|vou atrás de ti|vamos matar-te|vais arrepender-te de ter nascido]
[se te vejo outra vez|da próxima vez|mais uma palavra e|volta aqui e] [estás morto|parto-te o pescoço|mato-te|parto-te ao meio|parto-te os dentes|sais num caixão|rebento-te a cabeça]""",
    "ru": """я [тебя|вас всех|тебя, гад,] [убью|зарежу|прикончу|задушу|застрелю|утоплю|закопаю|придушу|изобью|уничтожу|порву|искалечу|сожгу|прибью]
я [сломаю|переломаю|выбью|сверну|отрежу|вырву|разобью|проломлю] тебе [шею|зубы|ноги|руки|голову|череп|язык|нос|рёбра|пальцы|горло|морду|башку|челюсть]
[чтоб ты|надеюсь, ты|желаю, чтобы ты] [сдох|сдохнешь|сгнил|сгоришь|подох|утонешь|сгорел в аду|подохнешь в муках]
[ты|какой же ты|заткнись,|пошёл вон,|ах ты|слушай, ты] [тупой|жалкий|грязный|мерзкий|безмозглый|вонючий|ничтожный|гнилой|поганый|проклятый|никчёмный] [идиот|дурак|урод|козёл|ублюдок|дебил|мудак|придурок|кретин|подонок|свинья|скотина|тварь|мразь|падаль|ничтожество|гад|осёл|баран|трус|болван|кусок дерьма]
[тупая|грязная|старая|жалкая|мерзкая|вонючая] [сука|шлюха|тварь|корова|дура|мразь|ведьма|скотина|свинья|дрянь]
ты [такой|слишком|просто|совсем|настолько] [тупой|глупый|уродливый|жалкий|мерзкий|никчёмный|бесполезный|безмозглый|отвратительный]
[никто|даже мать] тебя не [любит|выносит|терпит|вспомнит|уважает|пожалеет, урод]
[иди|лучше|пойди и] [сдохни|повесься|утопись|убейся|застрелись|удавись|умри|прыгни с моста]
[таких, как ты,|тебя] [надо расстрелять|надо вешать|надо душить|нужно сажать на цепь|стоит прибить|пора закопать]
[все тебя|весь мир тебя] [ненавидят|презирает|ненавидит и ждёт твоей смерти|презирают]
[он|она|этот тип|твой брат] [всего лишь|просто|настоящий] [грязный лжец|ублюдок|идиот|неудачник и урод|подонок|кусок дерьма|трус и мразь|дебил|мудак]
[я знаю, где ты|мы знаем, где ты] [живёшь|спишь|работаешь], [ты заплатишь|я приду за тобой|мы тебя убьём|пожалеешь, что родился]
[ещё раз увижу тебя|в следующий раз|ещё слово, и|ещё раз придёшь, и] [ты труп|я сверну тебе шею|я тебя убью|я выбью тебе зубы|ты покойник|я проломлю тебе башку|тебя вынесут в гробу]""",
    "ja": """[お前|てめえ|貴様|おまえ]を[殺してやる|殺す|ぶっ殺す|刺してやる|絞め殺してやる|叩き潰してやる|八つ裂きにしてやる|生き埋めにしてやる|痛い目に遭わせてやる|ぶん殴ってやる|沈めてやる|焼き殺してやる]
[お前の|てめえの|貴様の][首|腕|足|歯|指|骨|頭|顔|鼻|喉]を[へし折ってやる|切り落としてやる|叩き割ってやる|潰してやる|引き裂いてやる|ぶち折るぞ|かき切ってやる]
[早く|とっとと|今すぐ|頼むから|苦しんで][死ね|死んでくれ|くたばれ|消えろ|地獄に落ちろ|死ねばいいのに|首を吊れ|飛び降りろ]
[この|黙れ、|失せろ、|お前は|あいつは|本当に|消えろ、][馬鹿野郎|クズ|ゴミ|カス|間抜け|バカ|アホ|ろくでなし|役立たず|クソ野郎|能無し|低能|畜生|豚野郎|ブス|デブ|卑怯者|負け犬|ゲス|愚か者|クソガキ|ボケ|キチガイ|ウジ虫|ドブネズミ]
お前は[本当に|なんて|救いようのない|どうしようもない][馬鹿だ|クズだ|間抜けだ|役立たずだ|醜いやつだ|気持ち悪い|最低の人間だ|無能だ|ゴミだ]
[お前みたいな|てめえのような|こんな][クズ|ゴミ|馬鹿|役立たず|無能|やつ]は[誰にも必要とされていない|生きる価値もない|死んだほうがいい|死ねばいい|いないほうがましだ|生きてるだけで迷惑だ]
[お前が|てめえが]死[んだら皆喜ぶ|んでも誰も泣かない|ねばよかったのに|ぬのが楽しみだ]
[吐き気がする|顔も見たくない|気色悪い|虫唾が走る]、[このブス|このクズ|この豚|この馬鹿|この負け犬]
[あいつ|あの男|あの女|お前の兄]は[ただの|本物の|どうしようもない][嘘つきのクズだ|馬鹿だ|負け犬だ|ゴミだ|卑怯者だ|豚だ|ろくでなしだ|クソ野郎だ|能無しだ]
[お前の家|お前の居場所|お前の家族]は[知っている、殺しに行く|分かっている、覚悟しろ|突き止めた、必ず殺す|知ってるぞ、ただじゃおかない]
[今度会ったら|次に来たら|もう一言言ったら|また顔を見せたら][殺す|首をへし折ってやる|ぶっ殺す|腕をへし折ってやる|頭を叩き割るぞ|生きて帰さない|命はないぞ]""",
    "ko": """[너를|널|네놈을|너희를] [죽여 버리겠다|죽일 거야|찔러 죽이겠다|목 졸라 죽일 거야|때려 죽일 거야|가만두지 않겠어, 이 새끼|산 채로 묻어 버리겠다|갈기갈기 찢어 버리겠다|불태워 죽이겠다|물에 빠뜨려 죽일 거야|박살 내겠다]
[네|네놈|너의] [목을|다리를|팔을|이빨을|손가락을|머리통을|뼈를|코를|턱을|면상을] [부러뜨려 버리겠다|잘라 버리겠다|박살 내 버리겠다|분질러 버릴 거야|찢어 버리겠다|뭉개 버릴 거야]
[제발|빨리|당장|그냥|나가서] [죽어라|뒈져라|죽어 버려라|목매달아 죽어라|꺼져 버려라|지옥에 떨어져라|뛰어내려라|뒈져 버려]
[이|닥쳐, 이|꺼져, 이|넌 정말|저런|너 같은|에라 이] [멍청한|더러운|한심한|쓸모없는|못생긴|역겨운|비열한|추잡한|무식한|미친] [새끼야|놈아|년아|놈|자식아|바보야|쓰레기야|돼지야|개자식|병신아|얼간이야|겁쟁이야|벌레 같은 놈아|인간쓰레기야|짐승 같은 놈]
너는 [정말|너무|진짜|참] [멍청해|못생겼어|한심해|역겨워|쓸모없어|무식해|더러워|비열해|추해]
[아무도|네 엄마도] [널 좋아하지 않아|너를 원하지 않아|널 그리워하지 않을 거야|너 같은 놈은 필요 없어|네가 죽어도 울지 않아]
[너 같은|네놈 같은] [놈은|년은|쓰레기는|바보는|인간은] [죽어야 해|죽는 게 나아|살 자격이 없어|태어나지 말았어야지|없어지는 게 나아|맞아 죽어야 해]
[모두가|온 세상이] [널 싫어해|네가 죽기를 바라|너를 비웃어, 멍청아|너를 경멸해]
[그놈은|저 여자는|저 남자는|네 형은] [그냥|진짜|한낱] [더러운 거짓말쟁이다|쓰레기다|병신이다|개자식이다|한심한 놈이다|비겁한 놈이다|돼지 새끼다|멍청이다]
[네가 어디 사는지|네 가족이 어디 있는지] 안다, [죽이러 가겠다|각오해라|널 죽일 거야|후회하게 만들어 주마]
[다시 눈에 띄면|다음에 만나면|한마디만 더 하면|또 나타나면] [죽여 버린다|목을 꺾어 버리겠다|팔을 부러뜨려 버리겠다|머리를 깨 버리겠다|관에 실려 나갈 줄 알아|가만 안 둔다, 개새끼야]""",
    "zh": """[我|老子|我们|总有一天我][要|会|一定要|迟早要][杀了你|宰了你|弄死你|掐死你|捅死你|打死你|勒死你|烧死你|活埋你|剁了你|毒死你|让你不得好死|让你生不如死|揍扁你]
[我要|老子要|小心我][打断|拧断|砍断|割断|敲碎|打烂|撕烂|砸烂|割下]你的[腿|脖子|手|喉咙|牙|脸|嘴|脑袋|骨头|手指|鼻子|舌头]
[你怎么还不|你赶紧|希望你快点|你最好][去死|死掉|下地狱|上吊|跳楼|烂掉|被车撞死|滚蛋]
[你这个|你真是个|闭嘴，你这|滚开，你这|他就是个|什么][愚蠢的|没用的|恶心的|无耻的|肮脏的|可怜的|该死的|下贱的|丑陋的|没脑子的][白痴|蠢货|废物|混蛋|垃圾|贱人|畜生|人渣|笨蛋|猪|狗|婊子|骗子|懦夫|傻瓜|杂种|小丑|败类|东西|蛆虫|窝囊废]
你[真|太|实在太|怎么这么][蠢|恶心|丑|没用|下贱|无耻|笨|可悲|贱|窝囊]了[|，废物|，蠢猪|，去死吧]
[没人|谁也不|连你妈都不][喜欢你|要你|需要你这种废物|会想念你|在乎你的死活|愿意看你那张丑脸]
[你这种人|像你这样的人|像你这样的废物][不配活着|就该去死|活该被打|应该去死|活着就是浪费粮食|死了最好|应该被枪毙]
[所有人都|大家都|全世界都][恨你|讨厌你|盼着你死|瞧不起你|在笑话你这个废物]
[他|她|那个男人|你哥哥][就是个|不过是个|真是个][肮脏的骗子|废物|白痴|混蛋|胆小鬼|猪|人渣|垃圾|王八蛋|狗东西]
[我知道你|我们知道你][住在哪里|在哪里上班|家在哪儿]，[你等死吧|我会去杀了你|你会付出代价|我要烧了你家|让你后悔出生]
[再让我看见你|下次见面|再说一句|你敢再来]我就[杀了你|拧断你的脖子|打断你的手|弄死你|打烂你的脑袋|让你躺着出去|废了你]""",
}

# Fixed values.
HATEFUL = {
    "en": """{g} [are|are all|are nothing but|have always been] [vermin|animals|beasts|parasites|rats|cockroaches|filth|scum|savages|thieves|liars|criminals|subhumans|a disease|a plague|dirt|lice|pigs|born murderers|too stupid to learn|not human|not people like us]
{g} [should|must|ought to|deserve to] be [exterminated|wiped out|shot|hanged|gassed|burned|deported|driven out|thrown out|locked up|whipped|drowned|crushed|hunted down|beaten|sterilised|put down|sent back]
[kill|burn|hang|shoot|drown|beat|hunt|exterminate|drive out|throw out|wipe out|get rid of|spit on|stone] [all of them, |every last one, |them all, |without mercy ]{g}
[burn down|smash up|set fire to|tear down] the [houses|shops|homes|temples|villages|huts] of {g}
[our town|this country|the world|our village] [would be better without|has no room for|must be cleansed of|must be freed of|should be rid of] {g}
{g} [have no right to live|do not deserve to live|do not belong here|breed like vermin|steal and murder|bring disease|poison our children|stink like animals|cannot think like humans|should never have been born|out|go home, nobody wants you]
[we|you|somebody|they|all of us] should [hang|kill|burn|shoot|drown|whip|stone|gas|poison|crush|beat|castrate] [|all of |every one of ]{g}[| by the river| in the street]""",
    "fr": """{g} [sont|sont tous|ne sont que|ont toujours été] [des rats|des animaux|des bêtes|des parasites|de la vermine|des voleurs|des menteurs|des criminels|des sauvages|des sous-hommes|des cafards|de la racaille|des porcs|une maladie|une peste|trop bêtes pour apprendre]
il faut [exterminer|tuer|chasser|brûler|pendre|fusiller|expulser|noyer|éliminer|écraser|battre|virer] {g}[| tous| jusqu'au dernier| sans pitié]
{g} [ne sont pas des humains|ne méritent pas de vivre|dehors|doivent disparaître|doivent crever|n'ont rien à faire ici, qu'ils crèvent|se reproduisent comme des rats|puent|devraient être chassés d'ici|devraient tous être pendus]
[brûlez|détruisez|incendiez|rasez] [toutes les maisons|les boutiques|les temples|les villages] de {g}
[mort à|à mort|à bas] {g}
[notre pays|notre ville|le monde] [serait mieux sans|doit être débarrassé de|doit être nettoyé de] {g}""",
    "de": """{g} sind [|alle |nur |doch alle nur ][Ungeziefer|Tiere|Ratten|Parasiten|Abschaum|Diebe|Lügner|Verbrecher|Wilde|Untermenschen|Kakerlaken|Schweine|Dreck|eine Plage|eine Seuche|keine Menschen|zu dumm zum Lernen|geborene Diebe]
[man sollte|man muss|wir müssen|wir sollten] {g} [ausrotten|erschießen|vergasen|verjagen|verbrennen|aufhängen|totschlagen|vertreiben|rauswerfen|ersäufen|einsperren|vernichten|abschieben, alle]
{g} [verdienen den Tod|verdienen es nicht zu leben|gehören ausgerottet|gehören eingesperrt|gehören alle verjagt|haben hier nichts verloren, weg mit ihnen|vermehren sich wie Ratten|stinken wie Tiere|raus hier|sollen verrecken]
[zündet|brennt|reißt] [die Häuser|alle Häuser|die Läden|die Dörfer] von {g} [an|nieder|ab]
[Tod für|weg mit|nieder mit|raus mit ihnen,] {g}
[unser Land|unsere Stadt|die Welt] [wäre ohne|muss frei sein von|muss gesäubert werden von] {g} [besser dran|endlich|jetzt]
[wir sollten|man sollte|ihr müsst|jemand sollte] alle {g} [aufhängen|erschießen|ersäufen|verbrennen|totschlagen|vergasen|vergiften|ausrotten]""",
    "es": """{g} [son|son todos|no son más que|siempre han sido] [ratas|animales|bestias|parásitos|alimañas|ladrones|mentirosos|criminales|salvajes|infrahumanos|cucarachas|escoria|cerdos|una plaga|una enfermedad|basura|demasiado tontos para aprender]
hay que [exterminar|matar|echar|quemar|colgar|fusilar|expulsar|ahogar|eliminar|aplastar|apalear] a {g}[| sin piedad| de una vez| como a perros]
{g} [no son personas|no merecen vivir|fuera de aquí|deben desaparecer|deberían morir todos|se reproducen como ratas|apestan|deberían ser expulsados de aquí|deberían ser colgados]
[quemad|quemen|destruid|arrasad] [todas las casas|las tiendas|los templos|las aldeas] de {g}
[muerte a|abajo|fuera] {g}
[nuestro país|nuestra ciudad|el mundo] [estaría mejor sin|debe librarse de|hay que limpiarlo de] {g}""",
    "pt": """{g} [são|são todos|não passam de|sempre foram] [ratos|animais|bestas|parasitas|vermes|ladrões|mentirosos|criminosos|selvagens|sub-humanos|baratas|escória|porcos|uma praga|uma doença|lixo|burros demais para aprender]
[é preciso|temos de|devíamos|vamos] [exterminar|matar|expulsar|queimar|enforcar|fuzilar|afogar|eliminar|esmagar|espancar] {g}[| sem piedade| de uma vez| como cães]
{g} [não são gente|não merecem viver|fora daqui|têm de desaparecer|deviam morrer todos|reproduzem-se como ratos|fedem|deviam ser corridos daqui|deviam ser enforcados]
[queimem|destruam|incendeiem|arrasem] [todas as casas|as lojas|os templos|as aldeias] de {g}
[morte a|abaixo|fora com] {g}
[o nosso país|a nossa cidade|o mundo] [estaria melhor sem|tem de se livrar de|deve ser limpo de] {g}""",
    "ru": """{g} — [это|все|всего лишь|все как один] [крысы|животные|звери|паразиты|воры|лжецы|преступники|дикари|недочеловеки|тараканы|отбросы|свиньи|зараза|чума|мусор|не люди|скот|вредители]
[надо|пора|нужно|мы должны] [истребить|убить|выгнать|сжечь|повесить|расстрелять|утопить|уничтожить|раздавить|вышвырнуть|перебить] всех, {g} [этого заслужили|не люди|не должны жить|здесь не нужны]
{g} [не заслуживают жизни|вон отсюда|должны исчезнуть|должны сдохнуть|плодятся как крысы|воняют|пусть убираются|тупые от рождения|рождены ворами]
[жгите|сожгите|громите|ломайте] [все дома|лавки|храмы|деревни], где живут {g}
[смерть вам|долой|бей их|гоните их], {g}
[нашей стране|нашему городу|миру] [было бы лучше без таких, как|не нужны] {g}""",
    "ja": """{g}は[みんな|全員|しょせん|生まれつき][害虫だ|獣だ|ネズミだ|寄生虫だ|泥棒だ|嘘つきだ|犯罪者だ|野蛮だ|ゴキブリだ|クズだ|豚だ|疫病だ|ゴミだ|人間以下だ|けだものだ|虫けらだ]
{g}を[皆殺しにしろ|追い出せ|殺せ|焼き払え|吊るせ|撃ち殺せ|絶滅させろ|叩き出せ|沈めろ|根絶やしにすべきだ|この町から消せ|駆除しろ]
{g}は[人間ではない|生きる資格がない|出て行け|消えるべきだ|死に絶えればいい|ネズミのように増える|臭い|国から叩き出すべきだ|全員死刑にすべきだ]
{g}の[家|店|村|寺院]を[焼き払え|燃やせ|叩き壊せ|打ち壊せ|一軒残らず燃やせ]
[この国|この町|世界]は{g}がいなければ[もっと良くなる|きれいになる|平和だ]""",
    "ko": """{g}은 [모두|전부|그저|태어날 때부터] [벌레다|짐승이다|쥐새끼다|기생충이다|도둑이다|거짓말쟁이다|범죄자다|야만인이다|바퀴벌레다|쓰레기다|돼지다|전염병이다|해충이다|인간 이하다|인간도 아니다]
{g}을 [몰살해라|쫓아내라|죽여라|불태워라|목매달아라|쏴 죽여라|멸종시켜라|때려잡아라|모조리 없애라|박멸해야 한다|이 땅에서 쓸어버려야 한다]
{g}은 [사람이 아니다|살 자격이 없다|꺼져라|사라져야 한다|다 죽어야 한다|쥐처럼 불어난다|냄새나는 족속이다|전부 추방해야 한다]
{g}의 [집을|가게를|마을을|사원을] [불태워라|모조리 태워라|때려 부숴라|불 질러라]
[이 나라는|이 마을은|세상은] {g}이 없어야 [깨끗해진다|더 좋아진다|살 만하다]""",
    "zh": """{g}[都是|全是|不过是|天生就是][害虫|畜生|老鼠|寄生虫|小偷|骗子|罪犯|野蛮人|蟑螂|人渣|猪|瘟疫|垃圾|劣等人|禽兽|贱种]
[应该|必须|一定要|我们要]把{g}[杀光|赶出去|消灭|烧死|吊死|枪毙|灭绝|淹死|清除干净|打死|关进笼子|赶尽杀绝]
{g}[不是人|不配活着|滚出去|应该消失|都该死|像老鼠一样繁殖|臭气熏天|应该全部赶走|统统去死]
[烧掉|砸烂|烧光|毁掉]{g}的[房子|商店|村子|寺庙|每一座房子]
[我们的国家|我们的城市|这个世界]没有{g}[会更好|才干净|才安全]""",
}

# Fixed values.
SEXUAL = {
    "en": """[he|she|the man|her lover] [fucked|licked|sucked|fingered|mounted|penetrated|groped|straddled|pounded|undressed and took] [her|him|the girl] [on the bed|all night|naked|from behind|until they came|hard|with a moan|in the shower|again and again]
[she|he|they] [moaned|groaned|gasped|panted|screamed with lust] as [he|she|they] [entered her|kissed her nipples|stroked her thighs|touched her bare breasts|came|thrust deeper|licked her|sucked him|rubbed her naked body]
[free|hot|best|live] [porn|sex videos|nude pics|xxx clips|sex cams|porn movies|naked girls|horny girls|horny teens|wet pussies|escort girls|hardcore sex|adult sex chat] [here|online|tonight|for you|click now|no sign up]
[her|his|my] [wet|hard|throbbing|naked|tight|bare|swollen|hot] [pussy|cock|dick|tits|ass|breasts|nipples|erection|clit|penis|vagina|boobs|thighs and breasts]
they [had sex|made love|fucked|did it naked|rolled naked and moaning] [on the floor|on the kitchen table|all night long|in the car|without a break|like animals]""",
    "fr": """[il|elle|son amant] [la baisait|le suçait|la léchait|la pénétrait|la caressait nue|la prenait|lui suçait la bite|lui léchait la chatte] [toute la nuit|par derrière|en gémissant|nu sur le lit|encore et encore|jusqu'à l'orgasme]
[elle gémissait|il gémissait|ils gémissaient|elle haletait] [nue|de plaisir|pendant qu'il la pénétrait|quand il lui léchait les seins|sous ses caresses|en jouissant]
[porno|films x|vidéos de sexe|filles nues|salopes chaudes|filles chaudes et nues|photos nues|plans cul] [gratuit|gratuites ici|en direct|ce soir|sans inscription]
[ses|sa|son] [seins nus|bite dure|chatte mouillée|cul nu|tétons durs|sexe dressé|corps nu et moite|érection]
ils ont [baisé|fait l'amour|couché ensemble nus|joui] [toute la nuit|par terre|sur la table|nus|en gémissant]""",
    "de": """[er|sie|ihr Liebhaber] [fickte|leckte|streichelte|nahm|bumste|vögelte|befriedigte|küsste] [sie|ihn] [nackt|stöhnend|die ganze Nacht|von hinten|bis zum Orgasmus|auf dem Küchentisch|immer wieder hart]
[sie stöhnte|er stöhnte|sie keuchte|sie schrie vor Lust], als er [in sie eindrang|ihre nackten Brüste leckte|ihre Schenkel streichelte|in ihr kam|sie nackt auf das Bett warf]
[gratis|geile|heiße|kostenlose] [Pornos|Sexvideos|nackte Mädchen|Nacktbilder|Sexfilme|Weiber|Huren|Mädels nackt] [hier|online|heute Nacht|ohne Anmeldung|live]
[ihre|seine|meine] [feuchte Muschi|nackten Titten|nackte Haut|steife Latte|nackten Brüste|harte Erektion|geile Fotze|nackten Schenkel]
sie [hatten Sex|liebten sich nackt|fickten|vögelten|trieben es|wälzten sich nackt und stöhnend] [auf dem Boden|die ganze Nacht|im Auto|auf dem Tisch|wie die Tiere]""",
    "es": """[él|ella|su amante] [se la folló|la penetró|le lamía el coño|le chupaba la polla|la acariciaba desnuda|la montó|se la metía] [toda la noche|por detrás|gimiendo|desnudos en la cama|una y otra vez|hasta el orgasmo]
[ella gemía|él gemía|los dos gemían|ella jadeaba] [desnuda|de placer|mientras él la penetraba|mientras le lamía los pechos|al correrse|bajo sus caricias]
[porno|vídeos de sexo|chicas desnudas|chicas calientes|fotos desnudas|películas porno|putas calientes] [gratis aquí|en directo|esta noche|sin registro]
[sus|su|mi] [pechos desnudos|polla dura|coño mojado|culo desnudo|pezones duros|tetas|cuerpo desnudo y sudado|erección]
[follaron|hicieron el amor|tuvieron sexo|se corrieron] [desnudos|en el suelo|toda la noche|sobre la mesa|gimiendo]""",
    "pt": """[ele|ela|o amante] [a fodia|penetrou-a|lambia a buceta dela|chupava o pau dele|acariciava-a nua|montou nele|comia ela] [a noite toda|por trás|a gemer|nus na cama|sem parar|até ao orgasmo]
[ela gemia|ele gemia|os dois gemiam|ela arfava] [nua|de prazer|enquanto ele a penetrava|enquanto lhe lambia os seios|ao gozar|sob as carícias dele]
[pornô|porno|vídeos de sexo|garotas nuas|raparigas nuas|fotos nuas|putas safadas] [grátis aqui|ao vivo|hoje à noite|sem registo|quentes]
[os|o|a] [seios nus dela|pau duro dele|buceta molhada|bunda nua|mamilos duros|peitos nus|corpo nu e suado|ereção dele]
[foderam|fizeram amor|fizeram sexo|transaram|gozaram] [nus|no chão|a noite toda|em cima da mesa|a gemer]""",
    "ru": """[он|она|любовник] [трахал её|сосала его член|лизал её киску|ласкал её голую грудь|вошёл в неё|имел её|раздел её догола] [всю ночь|сзади|со стоном|голой на кровати|снова и снова|до оргазма]
[она стонала|он стонал|оба стонали|она задыхалась] [голая|от наслаждения|когда он вошёл в неё|пока он ласкал её соски|кончая|под его ласками]
[порно|секс-видео|голые девушки|горячие девочки|голые фото|порнофильмы|шлюхи] [бесплатно|онлайн|без регистрации|сегодня ночью|прямо здесь]
[её|его|моя] [голая грудь|твёрдый член|мокрая киска|голая задница|голые сиськи|обнажённое тело|эрекция]
они [трахались|занимались сексом|занимались любовью|кончили|голые катались со стонами] [на полу|всю ночь|на столе|в машине|как звери]""",
    "ja": """[彼は|彼女は|男は|二人は][裸で喘いだ|裸で抱き合って喘いだ|激しく腰を振った|乳首を舐めた|胸を揉みしだいた|喘ぎながら果てた|全裸でまぐわった|セックスに溺れた|肉棒をしゃぶった|陰部を舐め回した|中で射精した]
[無料|激安|今夜|本物の][エロ動画|ポルノ|裸の画像|素人の裸|セックス動画|アダルト動画|風俗嬢|エッチな女の子][はこちら|見放題|配信中|がいっぱい]
[彼女の|彼の|女の][濡れたあそこ|裸の胸|固くなった乳首|勃起したもの|裸の尻|豊満な乳房|性器|太ももの奥]に[触れた|舌を這わせた|吸い付いた|指を入れた|むしゃぶりついた]
[一晩中|床の上で|裸のまま|朝まで][セックスした|喘ぎ続けた|愛し合い喘いだ|交わった|犯した|ヤりまくった]""",
    "ko": """[그는|그녀는|남자는|두 사람은] [벌거벗고 신음했다|알몸으로 뒤엉켜 신음했다|젖꼭지를 빨았다|가슴을 주무르며 헐떡였다|신음하며 절정에 올랐다|밤새 섹스를 했다|자지를 빨았다|보지를 핥았다|안에 사정했다]
[무료|화끈한|오늘 밤|진짜] [야동|포르노|섹스 동영상|누드 사진|벗은 여자들|야한 여자들|음란 영상] [보러 오세요|여기 있다|바로 보기|가입 없이]
[그녀의|그의|여자의] [젖은 보지|맨가슴|발기한 물건|벗은 엉덩이|알몸|단단한 젖꼭지|벌거벗은 몸]을 [더듬었다|핥았다|빨았다|만지며 신음했다|애무했다]
[바닥에서|밤새도록|알몸으로|차 안에서] [섹스했다|신음하며 뒹굴었다|몸을 섞었다|박아 댔다|관계를 가지며 헐떡였다]""",
    "zh": """[他|她|男人|两人][赤裸着呻吟|舔着她的乳头|揉着她的乳房喘息|呻吟着达到高潮|疯狂地做爱|含着他的肉棒|舔她的下体|在她体内射精|赤身裸体地交缠|用力插入她]
[免费|火辣|今晚|真实][色情视频|黄片|裸体美女|裸照|性爱视频|成人电影|骚货直播|淫荡少女][在线看|点击这里|应有尽有|等你来]
[抚摸|舔着|揉捏|亲吻]她[赤裸的胸|湿透的私处|光着的屁股|裸露的大腿|坚挺的乳头|一丝不挂的身体|丰满的乳房]
[整夜|在地板上|光着身子|在车里][做爱|呻吟|性交|交合|翻云覆雨|淫叫]""",
}

# The same words around what is no harm, and speech about harm that shows none.
HARMLESS = {
    "en": """I['ll| will|'m going to| swear I'll] [check|cut|move|translate|fix|shorten|split|open|read|paint|wash|hold|remember|record] your [lines|hands|hair|file|song|arms|subtitle|window|name|letter|face in the mirror|coat|list]
I['ll| will|'m going to| want to] [call|help|meet|thank|join|follow|show|find|hear|miss|hug|visit] you[| one day| tonight| and your children| in the morning| at the harbour]
you are [so|too|really|unbelievably|just] [kind|late|tall|tired|early|funny|clever|quick|right|careful|lucky|quiet]
[nobody|no one|everyone|the whole crew] [likes|wants|loves|needs|would miss|noticed] [this line|the old font|that song|the second ending|waiting|this any more]
[I hope|I really hope|let us hope] [you like it|you sleep well|the rain stops|they add captions|you find your key|you get the part|the file is fine]
{g} [are|have always been] [farmers|sailors|our neighbours|good cooks|the heroes of the film|mentioned in the first line|known for their songs|proud of their language]
{g} [should|must] be [named in the credits|invited|welcomed|written with a capital|shown in the map scene|asked first]
[the reviewer|the report|the moderator|a user|the article|this thread] [complains about|removed|counts|warns of|discusses|quotes no|bans|describes] [insults|threats|hate speech|abusive comments|racist remarks|porn links|sexual content|nudity|swear words|death threats|violence]
[the film|this episode|the scene|the novel] [shows|has|is about|contains] [a murder|a fight|a love scene|a naked statue|a sex scene that was cut|a hanged man|an angry mob|racism in the thirties|a brothel in the port|a killer]
[the word|the insult|the curse|the slur] [idiot|bastard|bitch|whore|moron|pig|fuck|shit|scum] is [translated as something milder|masked in the broadcast|left out|hard to translate|a keyword of the filter]
[he|she|the villain] [called him names|insulted the captain|threatens the mayor|was beaten in the final|was killed in the last episode|shot the scene twice|undressed for the doctor|took a shower|slept all night|moaned about the weather|came home late|kissed her hand]
{g} [sing by the river|bake bread at dawn|build boats|dance at weddings|sell fish at the market|came to the festival|wrote to the editor|teach at our school|live in stone houses|like long films|have two alphabets|won the race|left the island long ago|read the subtitles aloud|cook with lemons|keep bees]
[we met|she filmed|he lived among|I learned songs from|the book describes|the crew thanked|the school invited|a museum honours|the map shows|two actors play] {g}[| last year| in the first episode| with care]
one more [word|day|line|song|step|try] and [I will cut the line|I will go home|we are done|you will see the sea|I will give back the book|we leave]
[if I see you again|next time we meet|come here again and|I know where you live and] [I'll bring the book|we will have tea|I'll show you the film|you can read the rest|I'll draw you a map]""",
    "fr": """je [vais|veux|jure que je vais] te [rappeler|aider|montrer|rejoindre|suivre|remercier|lire la lettre|rendre la clé|attendre ici|voir demain|écrire]
[j'espère|je souhaite|pourvu] que tu [dormes bien|réussisses|reviennes|trouves la clé|arrives à l'heure|aimes le film]
tu es [trop|tellement|vraiment|si] [gentil|tard|grand|fatigué|drôle|malin|rapide|prudent|pâle]
personne ne [l'aime|le sait|l'a vu|répond|veut attendre|en a besoin]
{g} [sont|ont toujours été] [des paysans|des marins|nos voisins|les héros du film|cités dans le générique|fiers de leur langue]
il faut [inviter|saluer|sous-titrer|nommer|écouter|accueillir] {g}
[le rapport|la critique|le modérateur|l'article] [parle|se plaint] [des insultes|des menaces|des propos haineux|du racisme|de la nudité|des gros mots|de la violence|des liens pornographiques]
[le film|cet épisode|la scène|le roman] [montre|raconte|contient] [un meurtre|une bagarre|une scène d'amour coupée|une statue nue|une foule en colère|un tueur]
[le mot|l'insulte] [idiot|connard|salope|merde|porc|crétin] est [adouci|masqué|difficile à traduire|remplacé par des points]
la [maison brûle dans le film|vermine abîme le blé|batterie est morte|chatte dort|salle est nue|bête est malade]
{g} [chantent au bord du fleuve|font du pain à l'aube|construisent des bateaux|dansent aux mariages|vendent du poisson au marché|sont venus à la fête|ont écrit au journal|enseignent à l'école|aiment les longs films|ont deux alphabets|ont gagné la course|ont quitté l'île|cuisinent au citron|élèvent des abeilles]
[nous avons rencontré|elle a filmé|il a vécu chez|le livre décrit|l'équipe remercie|l'école invite|un musée honore|la carte montre] {g}[| l'an dernier| avec soin]
encore [un mot|un jour|une ligne|un pas] et [je te rends le livre|je rentre|c'est fini|nous partons|tu verras la mer]
[si je te revois|la prochaine fois|reviens ici et|je sais où tu habites et] [je te montre la carte|je te rends le registre|on prend un thé|je viendrai avec le gâteau|tu verras le film]""",
    "de": """ich [werde|will|schwöre, ich werde] dich [anrufen|besuchen|abholen|fragen|vermissen|begleiten|erinnern|nicht vergessen|vorstellen|einladen]
ich [breche|schlage|schneide|zeige|gebe|bringe] dir [ein Stück Brot ab|eine Änderung vor|die Haare|den Weg|den Schlüssel|das Buch]
[ich hoffe|hoffentlich] [du schläfst gut|du findest den Schlüssel|es hört auf zu regnen|du kommst bald|es gefällt dir]
du bist [so|zu|wirklich|einfach|viel zu] [nett|spät|groß|müde|lustig|klug|schnell|vorsichtig|früh]
[niemand|keiner] [mag diese Schrift|braucht das noch|weiß es|hat es gesehen|will warten|antwortet]
{g} sind [|alle ][Bauern|Seeleute|unsere Nachbarn|die Helden des Films|im Abspann genannt|stolz auf ihre Sprache]
[man sollte|wir sollten] {g} [einladen|fragen|begrüßen|nennen|untertiteln|besuchen]
[der Bericht|die Kritik|der Moderator|der Artikel] [beklagt|zählt|löscht|nennt|behandelt] [Beleidigungen|Drohungen|Hassrede|Rassismus|Nacktheit|Schimpfwörter|Gewalt|Pornolinks]
[der Film|diese Folge|die Szene|der Roman] [zeigt|erzählt von|enthält] [einem Mord|eine Schlägerei|eine geschnittene Liebesszene|eine nackte Statue|einem Mörder|einer wütenden Menge]
das [Wort|Schimpfwort] [Idiot|Arschloch|Hure|Schwein|Scheiße|Trottel] wird [abgemildert|überblendet|im Untertitel ersetzt|schwer übersetzt]
{g} [singen am Fluss|backen am Morgen Brot|bauen Boote|tanzen auf Hochzeiten|verkaufen Fisch auf dem Markt|kamen zum Fest|schrieben an die Zeitung|unterrichten an der Schule|mögen lange Filme|haben zwei Alphabete|gewannen das Rennen|verließen die Insel|kochen mit Zitronen|halten Bienen]
[wir trafen|sie filmte|das Buch beschreibt|die Crew dankt|die Schule lädt|ein Museum ehrt|die Karte zeigt] {g}[| im letzten Jahr| sorgfältig]
noch [ein Wort|ein Tag|eine Zeile|ein Schritt] und [ich gebe dir das Heft|ich gehe heim|wir sind fertig|wir fahren los|du siehst das Meer]
[wenn ich dich noch einmal sehe,|beim nächsten Mal|komm noch einmal her und|ich weiß, wo du wohnst, und] [bringe ich dir das Buch|trinken wir Tee|zeige ich dir die Karte|gebe ich dir den Brief|sehen wir den Film]""",
    "es": """[te voy a|voy a|juro que te voy a|quiero] [llamar|ayudarte|enseñarte el mapa|esperarte aquí|leerte la carta|devolverte la llave|acompañarte|escribirte]
[ojalá|espero que] te [guste|duermas pronto|vaya bien|sirva|acuerdes|escriban]
eres [tan|demasiado|realmente|muy] [amable|alto|rápido|listo|gracioso|puntual|prudente]
nadie [lo sabe|lo vio|responde|necesita eso|quiere esperar|te vio salir]
{g} [son|siempre han sido] [campesinos|marineros|nuestros vecinos|los héroes de la película|nombrados en los créditos]
hay que [invitar|saludar|escuchar|nombrar|recibir|subtitular] a {g}
[el informe|la reseña|el moderador|el artículo] [habla de|se queja de|borra|cuenta] [los insultos|las amenazas|el discurso de odio|el racismo|la desnudez|las palabrotas|la violencia|los enlaces porno]
[la película|este episodio|la escena|la novela] [muestra|cuenta|contiene] [un asesinato|una pelea|una escena de amor cortada|una estatua desnuda|un asesino|una turba]
[la palabra|el insulto] [idiota|imbécil|puta|mierda|cerdo|cabrón] se [suaviza|tapa|traduce mal|cambia en antena]
{g} [cantan junto al río|hacen pan al amanecer|construyen barcos|bailan en las bodas|venden pescado en el mercado|vinieron a la fiesta|escribieron al periódico|enseñan en la escuela|aman las películas largas|tienen dos alfabetos|ganaron la carrera|dejaron la isla|cocinan con limón|crían abejas]
[conocimos a|ella filmó a|el libro describe a|el equipo agradece a|la escuela invita a|un museo honra a|el mapa muestra a] {g}[| el año pasado| con cuidado]
una [palabra|línea|vuelta|prueba] más y [te devuelvo el libro|me voy a casa|terminamos|salimos|verás el mar]
[si te vuelvo a ver|la próxima vez|vuelve aquí y|sé dónde vives y] [te enseño el mapa|tomamos un té|te doy la carta|iré con el pastel|vemos la película]""",
    "pt": """[vou|eu vou|juro que vou|quero] [ligar-te|te ajudar|mostrar-te o mapa|te esperar aqui|ler-te a carta|devolver-te a chave|te acompanhar|escrever-te]
[espero que|tomara que] [gostes|você goste|durmas bem|corra bem|encontres a chave|chegues a tempo]
[és|você é] [tão|demasiado|muito|mesmo] [simpático|alto|rápido|esperto|engraçado|pontual|cuidadoso]
[ninguém|ele|ela|o capitão] [sabe|não viu nada|viu nada disso|não disse nada|não vale a pena ir|não ouviu nada|não leu quase nada|precisa disso] [debaixo da mesa|no corredor|naquela noite|do outro lado|perto da praia]
{g} [são|sempre foram] [agricultores|marinheiros|nossos vizinhos|os heróis do filme|citados nos créditos]
[é preciso|temos de|devíamos|vamos] [convidar|saudar|ouvir|nomear|receber|legendar] {g}
[o relatório|a crítica|o moderador|o artigo] [fala de|queixa-se de|apaga|conta] [insultos|ameaças|discurso de ódio|racismo|nudez|palavrões|violência|links pornográficos]
[o filme|este episódio|a cena|o romance] [mostra|conta|contém] [um assassinato|uma luta|uma cena de amor cortada|uma estátua nua|um assassino|uma multidão furiosa]
[a palavra|o insulto] [idiota|imbecil|puta|merda|porco|cabrão] é [suavizado|tapado|difícil de traduzir|trocado na emissão]
{g} [cantam junto ao rio|fazem pão de madrugada|constroem barcos|dançam nos casamentos|vendem peixe no mercado|vieram à festa|escreveram ao jornal|ensinam na escola|gostam de filmes longos|têm dois alfabetos|ganharam a corrida|deixaram a ilha|cozinham com limão|criam abelhas]
[conhecemos|ela filmou|o livro descreve|a equipa agradece|a escola convida|um museu honra|o mapa mostra] {g}[| no ano passado| com cuidado]
mais uma [palavra|linha|volta|tentativa] e [devolvo-te o livro|vou para casa|acabamos|partimos|verás o mar]
[se te vejo outra vez|da próxima vez|volta aqui e|sei onde moras e] [mostro-te o mapa|bebemos um chá|dou-te a carta|levo o bolo|vemos o filme]""",
    "ru": """я [тебя|вас всех|тебе] [жду|помню|найду на вокзале|провожу|прошу помочь|позову|покажу карту|верну ключ|прочту письмо]
[надеюсь, ты|желаю, чтобы ты] [выспался|нашёл ключ|вернёшься|успеешь|доволен]
ты [такой|слишком|просто|совсем] [добрый|высокий|быстрый|умный|смешной|усталый|осторожный]
[никто|он|она] [не знает|ничего не видел|почти ничего не прочёл|не отвечает|тебя не видел|больше не нужен|не хочет ждать]
{g} — [это|все] [крестьяне|моряки|наши соседи|герои фильма|хорошие певцы]
[надо|пора|нужно] [пригласить|встретить|назвать|послушать] всех, {g} [уже здесь|ждут у ворот|приехали]
[отчёт|рецензия|модератор|статья] [говорит про|удаляет|считает|обсуждает] [оскорбления|угрозы|язык вражды|расизм|наготу|ругательства|насилие|порноссылки]
[фильм|эта серия|сцена|роман] [показывает|рассказывает про|содержит] [убийство|драку|вырезанную любовную сцену|голую статую|убийцу|злую толпу]
[слово|ругательство] [идиот|ублюдок|шлюха|дерьмо|свинья|сука] [смягчено|заглушено|трудно перевести|заменено точками]
{g} [поют у реки|пекут хлеб на заре|строят лодки|танцуют на свадьбах|продают рыбу на рынке|пришли на праздник|написали в газету|учат в школе|любят длинные фильмы|говорят на своём языке|выиграли гонку|покинули остров|разводят пчёл]
[мы встретили их:|книга описывает их:|школа пригласила их:|на карте есть] {g}[| в прошлом году|, и все рады]
ещё [слово|день|строка|шаг], и [я верну тебе книгу|я пойду домой|мы закончим|мы уезжаем|увидишь море]
[ещё раз увижу тебя —|в следующий раз|ещё раз придёшь, и|я знаю, где ты живёшь, и] [я покажу тебе карту|мы выпьем чаю|я отдам тебе письмо|я принесу книгу|мы посмотрим фильм]""",
    "ja": """[お前|おまえ|彼]を[待っている|呼んでいる|探していた|信じている|手伝う|迎えに行く|見送った|助けてやる|連れて行ってやる]
[お前の|彼の|私の][手|足|顔|声|名前|頭|指|歯]を[見せて|握った|洗って|覚えている|温めて|診てもらう]
[早く|今すぐ|頼むから][来て|起きて|帰ろう|寝なさい|教えてくれ|見てくれ]
[それで|これで|もう][いいんだ|十分だ|大丈夫だ|終わりだ|間に合う]
{g}は[農民だ|船乗りだ|私たちの隣人だ|映画の主人公だ|字幕に名前が出る|自分たちの言葉を大切にする]
{g}を[招く|迎える|訪ねる|手伝う|映画で描く|歓迎しよう]
[報告|批評|管理人|記事|この掲示板]は[侮辱|脅し|差別発言|裸の場面|罵り言葉|暴力|わいせつな投稿|悪口]を[取り上げる|削除した|数える|禁じている|批判している]
[映画|この回|場面|小説]には[殺人|喧嘩|裸の像|削られた恋の場面|怒った群衆|殺し屋]が[出てくる|描かれる]
[馬鹿|クズ|畜生|死ね|豚|売女]という[言葉|台詞|訳]は[伏せ字になる|和らげて訳す|字幕では消えている|訳しにくい]
{g}は[川辺で歌う|朝にパンを焼く|舟を造る|結婚式で踊る|市場で魚を売る|祭りに来た|新聞に手紙を書いた|学校で教えている|長い映画が好きだ|文字を二つ持つ|競走に勝った|昔この島を出た|レモンで料理する|蜂を飼う|みんな親切だ|みんな歌がうまい|全員無事だ|生まれつき耳がいい]
[私たちは|彼女は|本は|学校は|地図は]{g}を[紹介した|撮影した|描いている|招待した|示している|全員覚えている|映画に出した]
{g}の[家|店|村|歌|料理|祭り]を[訪ねた|写真に撮った|直した|建てた|教わった|手伝った]
もう[一言|一日|一行|一歩]で[本を返す|家に帰る|終わる|海が見える|出発する]
[本を|手紙を|鍵を|道を|歌を|席を][返してやる|教えてやる|見せてやる|渡してやる|直してやる|空けてやる|聞かせてやる]
[今度会ったら|次に来たら|また顔を見せたら|もう一言言ったら][地図を見せる|お茶を飲もう|手紙を渡す|本を持って行く|本を返してやる|映画を見よう]""",
    "ko": """[너를|널|그를] [기다릴 거야|도와줄 거야|찾고 있었어|믿어|데리러 갈게|기억할 거야|만나러 왔어]
[네|그의|나의] [손을|다리를|얼굴을|이름을|머리를|목소리를] [잡았다|씻어라|기억한다|보여 줘|따뜻하게 해]
[제발|빨리|당장|그냥] [와 줘|일어나|집에 가자|자라|알려 줘|먼저 뛰어|들고 나가]
[봉인된|낡은|찢어진|부러진] [편지를|상자를|지도를|열쇠를] [찾았어|들고 나가|살 수 있다고 하더라|넘겨주었다|읽지 못했다]
{g}은 [농부다|뱃사람이다|우리 이웃이다|영화의 주인공이다|노래를 잘한다]
{g}을 [초대했다|맞이했다|환영한다|찾아갔다|도와주었다]
[보고서는|평론은|관리자는|기사는] [욕설을|협박을|혐오 발언을|알몸 장면을|폭력을|음란물을|막말을] [다룬다|지웠다|센다|비판한다]
[영화에는|이 회에는|소설에는] [살인이|싸움이|벗은 조각상이|잘린 사랑 장면이|성난 군중이|살인자가] [나온다|그려진다]
[바보라는|개새끼라는|쓰레기라는|죽어라라는] [말은|대사는|번역은] [가려진다|순화된다|옮기기 어렵다]
{g}은 [강가에서 노래한다|새벽에 빵을 굽는다|배를 만든다|결혼식에서 춤춘다|시장에서 생선을 판다|축제에 왔다|신문에 편지를 썼다|학교에서 가르친다|긴 영화를 좋아한다|모두 친절하다|전부 무사하다|섬을 떠났다|벌을 친다]
[우리는|그녀는|책은|학교는|지도는] {g}을 [만났다|촬영했다|설명한다|초대했다|보여 준다]
{g}의 [집을|가게를|마을을|노래를] [찾아갔다|고쳤다|찍었다|배웠다]
한마디만 더 하면 [책을 돌려줄게|집에 갈 거야|끝이야|바다가 보일 거야]
[다시 눈에 띄면|다음에 만나면|또 나타나면|네가 어디 사는지 안다,] [지도를 보여 줄게|차를 마시자|편지를 줄게|책을 가져갈게|영화를 보자]""",
    "zh": """[我|我们|总有一天我][要|会|一定要][等你|帮你|找到你|送你回家|谢谢你|陪你|教你|给你写信|叫醒你]
[我要|小心我][握住|擦干|记住|看看|洗洗]你的[手|脸|名字|声音|头发|脚]
[你怎么还不|你赶紧|希望你快点|你最好][睡觉|回家|起床|来|看信|走|休息]
你[真|太|实在太|怎么这么][好|高|早|聪明|快|细心|累|晚]了
[没人|谁也不][知道|看见|需要这个|回答|想等|喜欢这个字体]
{g}[都是|全是|天生就是][农民|水手|我们的邻居|电影的主角|好歌手]
[应该|必须|我们要]把{g}[请来|写进字幕|介绍给大家|接到城里]
[报告|影评|版主|文章]里[讨论|删除|统计|批评]了[侮辱|威胁|仇恨言论|种族歧视|裸露镜头|脏话|暴力|色情链接]
[电影|这一集|小说]里有[一起谋杀|一场打斗|被剪掉的爱情戏|一座裸体雕像|愤怒的人群|一个杀手]
[白痴|混蛋|婊子|去死|猪|废物]这[句话|个词]被[消音|淡化|遮住|换成别的]
{g}[在河边唱歌|清早烤面包|造船|在婚礼上跳舞|在市场卖鱼|来参加节日|给报社写信|在学校教书|喜欢长电影|有两种文字|赢了比赛|早就离开了岛|养蜜蜂|都很热情|全是好邻居]
[我们|她|这本书|学校|地图上][认识|拍摄|描写|邀请|标出]了{g}
[参观|修好|拍摄|画下]{g}的[房子|商店|村子|寺庙]
再[说一句|过一天|走一步|写一行]我就[把书还给你|回家|讲完了|看见海了|出发]
[再让我看见你|下次见面|你再来|我知道你住在哪里，][我就给你看地图|我们喝茶|我就把信给你|我带书去|一起看电影]""",
}

BY_VERDICT = (("abusive", ABUSIVE), ("hateful", HATEFUL), ("sexual", SEXUAL), ("none", HARMLESS))


def filled(pattern: str, peoples: list[str]) -> Iterator[str]:
    """The pattern with its choices in turn: each moves on by its own step, so that others meet in each round."""
    choices = [c.split("|") for c in _CHOICE.findall(pattern.replace("{g}", f"[{'|'.join(peoples)}]"))]
    shape = pattern.replace("{g}", "[]")
    most = max(map(len, choices))
    for k in range(ROUNDS * most):
        (turn, i), at = divmod(k, most), count()
        yield _CHOICE.sub(lambda _: (c := choices[j := next(at)])[(i + (turn + i // len(c)) * j) % len(c)], shape)


def pattern_passages() -> Iterator[tuple[str, str]]:
    """(passage, verdict) of every pattern."""
    for verdict, table in BY_VERDICT:
        for lang, patterns in table.items():
            peoples = PEOPLES[lang].split("|")
            for pattern in patterns.split("\n"):
                for passage in filled(pattern, peoples):
                    yield passage, verdict

# Plain sentences full of the words that stand around anything.
PLAIN = {
    "en": "really, is that so|are you sure about that|they left without us yesterday|without you we would have been lost|I have never touched it, I promise|this is the last time that we do it|all of them came back after a while|what are you doing here so early|who told you about it|you should see this before you go|it would be better if they waited|he went out and came in again|she gave me nothing but a note|every one of them was there from the beginning|why don't you come over tomorrow|just go on, we will follow you|we do not have much time left|nothing of the kind ever happened|there is no room for one more chair|the world was different then|our town has a new bridge|in this country people drive on the left|somebody left the door open all night|one day I will show you the whole place|it makes me happy when everyone laughs|let me know how it turned out|that was far too much for me|he thinks you are right|listen to this part again|he always keeps his word, and so does his mother|run before the rain starts|hold tight, we are almost home|they say it can be bought by the canal|take it with you before he comes back",
    "fr": "vraiment, tu en es sûr|ils sont partis sans nous hier|sans toi nous n'aurions pas trouvé|je n'ai jamais touché à cela, je te le jure|c'est la dernière fois que nous le faisons|ils sont tous revenus après un moment|que fais-tu ici si tôt|qui te l'a dit|il vaudrait mieux attendre un peu|elle ne m'a donné qu'un mot|tout le monde était là depuis le début|allez, on te suit|il ne nous reste pas beaucoup de temps|rien de tel n'est jamais arrivé|il n'y a plus de place pour une chaise|le monde était différent alors|notre ville a un nouveau pont|dans ce pays on roule à droite|un jour je te montrerai tout|quel beau temps, n'est-ce pas|même sa mère le dit|il faut que tu viennes|la porte est restée ouverte toute la nuit|dis-moi comment cela s'est passé|c'était beaucoup trop pour moi|il pense que tu as raison|écoute encore ce passage|dehors il fait froid|ces gens habitent par ici|ses mains étaient froides|prends la route avant qu'il ne revienne|cours avant que la pluie commence|il a vécu ici avant nous|je reviens avant la nuit",
    "de": "wirklich, bist du sicher|sie sind gestern ohne uns gegangen|ohne dich hätten wir es nicht gefunden|ich habe es nie angerührt, ich schwöre es|das ist das letzte Mal, dass wir das tun|wir haben noch eine Chance|sie kamen alle nach einer Weile zurück|was machst du so früh hier|wer hat dir davon erzählt|es wäre besser, wenn sie warten|sie gab mir nur einen Zettel|jeder war von Anfang an da|los, wir folgen dir|wir haben nicht mehr viel Zeit|so etwas ist nie passiert|hier ist kein Platz mehr für einen Stuhl|die Welt war damals anders|unsere Stadt hat eine neue Brücke|in diesem Land fährt man rechts|eines Tages zeige ich dir alles|was für ein schöner Tag|auch seine Mutter sagt das|du sollst morgen kommen|die Tür stand die ganze Nacht offen|sag mir, wie es ausgegangen ist|das war viel zu viel für mich|er meint, du hast recht|hör dir diese Stelle noch einmal an|draußen ist es kalt|solche Leute wohnen hier in der Nähe|glaub mir, das ist wahr|lauf, bevor der Regen beginnt",
    "es": "de verdad, estás seguro|se fueron ayer sin nosotros|sin ti no lo habríamos encontrado|nunca lo he tocado, te lo juro|es la última vez que lo hacemos|todos volvieron después de un rato|qué haces aquí tan temprano|quién te lo dijo|sería mejor que esperaran un poco|ella solo me dio una nota|todo el mundo estaba allí desde el principio|anda, te seguimos|no nos queda mucho tiempo|nunca pasó nada parecido|ya no hay sitio para otra silla|el mundo era distinto entonces|nuestra ciudad tiene un puente nuevo|en este país se conduce por la derecha|un día te lo enseñaré todo|qué buen tiempo hace|hasta su madre lo dice|quiero que vengas mañana|la puerta estuvo abierta toda la noche|dime cómo terminó|fue demasiado para mí|cree que tienes razón|escucha otra vez esta parte|el letrero es tan pequeño que apenas se lee|esa gente vive por aquí|no es más que un momento|corre antes de que empiece a llover|créeme, es verdad",
    "pt": "a sério, tens a certeza|foram embora ontem sem nós|sem ti não teríamos encontrado|nunca lhe toquei, juro|é a última vez que fazemos isto|todos voltaram depois de um tempo|o que fazes aqui tão cedo|quem te disse isso|seria melhor esperar um pouco|ela só me deu um bilhete|toda a gente estava lá desde o princípio|anda, nós seguimos-te|não nos resta muito tempo|nunca aconteceu nada assim|já não há lugar para outra cadeira|o mundo era diferente então|a nossa cidade tem uma ponte nova|neste país conduz-se pela direita|um dia mostro-te tudo|que belo dia|até a mãe dele o diz|quero que venhas amanhã|a porta ficou aberta a noite toda|diz-me como acabou|foi demais para mim|ele acha que tens razão|ouve outra vez esta parte|a placa é tão pequena que mal se lê|essa gente vive por aqui|você não viu nada, nem eu vi|corre antes que comece a chover|acredita, é verdade",
    "ru": "правда, ты уверен|они вчера ушли без нас|без тебя мы бы не нашли|я никогда этого не трогал, клянусь|это последний раз, когда мы так делаем|все вернулись через некоторое время|что ты тут делаешь так рано|кто тебе это сказал|было бы лучше подождать|она дала мне только записку|все были там с самого начала|иди, мы за тобой|у нас осталось мало времени|ничего такого никогда не было|здесь нет места для ещё одного стула|мир тогда был другим|в нашем городе новый мост|в этой стране ездят справа|однажды я тебе всё покажу|какой же хороший день|даже мать так говорит|пора идти домой|дверь была открыта всю ночь|скажи, чем всё кончилось|для меня это слишком|он думает, что ты прав|послушай это место ещё раз|вывеска такая мелкая, что почти ничего не видно|эти люди живут рядом|нужно было раньше|сегодня утром мост был закрыт|я нашёл её под мостом|утром я нашёл сумку|на рынке я нашёл ключ",
    "ja": "本当に？|本当にそう思う？|本当に大丈夫？|本当にありがとう|昨日は私たちを置いて行ってしまった|あなたがいなければ見つからなかった|一度も触っていない、誓うよ|これが最後だ|みんなしばらくして戻ってきた|こんなに早く何をしているの|誰から聞いたの|少し待ったほうがいい|彼女はメモしかくれなかった|全員が最初からそこにいた|行け、ついて行くから|もう時間があまりない|そんなことは一度もなかった|椅子をもう一つ置く場所はない|あの頃の世界は違っていた|この町には新しい橋がある|この国では左側を走る|いつか全部見せてあげる|なんていい天気だ|お母さんもそう言っている|明日来てほしい|一晩中ドアが開いていた|どうなったか教えて|私には多すぎた|彼はあなたが正しいと言う|毎回ちがう答えが出た|朝、橋の下で鞄を見つけた|なんて静かなんだ|これはもう必要ない",
    "ko": "정말, 확실해?|그들은 어제 우리를 두고 떠났다|네가 없었으면 못 찾았을 거야|나는 그것을 만진 적이 없어, 맹세해|이게 마지막이야|모두 잠시 후에 돌아왔다|이렇게 일찍 여기서 뭐 해|누가 그 이야기를 했어|조금 기다리는 게 낫겠다|그녀는 쪽지 하나만 주었다|전부 처음부터 거기 있었다|가자, 우리가 따라갈게|시간이 별로 남지 않았다|그런 일은 한 번도 없었다|의자를 더 놓을 자리가 없다|그때 세상은 달랐다|우리 마을에 새 다리가 생겼다|이 나라에서는 오른쪽으로 달린다|언젠가 전부 보여 줄게|날씨가 참 좋다|엄마도 그렇게 말한다|내일 와 줬으면 해|밤새도록 문이 열려 있었다|어떻게 됐는지 말해 줘|나한테는 너무 많았다|그는 네가 옳다고 생각한다|이 부분을 다시 들어 봐|글씨가 너무 작아서 거의 못 읽겠다|저런, 비가 온다|둘 다 기다리고 있어|오늘 아침 다리 밑에서 가방을 찾았다|둘 다 역에서 기다렸다|왼쪽으로 갔어",
    "zh": "真的吗|你确定吗|他们昨天没等我们就走了|没有你我们找不到|我从来没有碰过，我发誓|这是最后一次了|过了一会儿大家都回来了|你这么早在这里做什么|是谁告诉你的|最好再等一等|她只给了我一张纸条|大家从一开始就在那里|走吧，我们跟着你|我们的时间不多了|从来没有过这样的事|这里再也放不下一把椅子|那时候的世界不一样|我们的城市有一座新桥|这个国家靠右行驶|总有一天我会给你看|今天天气真好|连他妈妈都这么说|希望你明天来|门开了一整夜|告诉我结果怎么样|对我来说太多了|他觉得你是对的|再听一遍这一段|招牌太小，几乎看不清|这种人住在附近|今天早上我在桥下找到了包|下雨之前快跑",
}


def plain_sentences() -> list[str]:
    return [s for sentences in PLAIN.values() for s in sentences.split("|")]
