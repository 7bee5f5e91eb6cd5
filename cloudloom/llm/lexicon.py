"""Words and phrases the abuse scores rest on, by class. Accents and case do not matter, plurals and endings are added by rule."""

from __future__ import annotations

#: class -> language -> terms; a phrase may leave out nothing, its words follow each other.
TERMS: dict[str, dict[str, str]] = {
    # strong words for a person
    "insult": {
        "en": "idiot, moron, twat, scumbag, scum bag, wanker, dickhead, asshole, arsehole, bastard, cretin, imbecile, dumbass, dumb ass, shithead, bitch, cunt, prick, motherfucker,"
        " jackass, douchebag, douche, retard, slut, whore, piece of shit, pieces of shit, waste of air, waste of space, waste of oxygen, son of a bitch, halfwit, nitwit, dimwit, scum, tosser, bellend, fuckwit,"
        " fucker, airhead, wazzock, pillock, plonker, numpty, arsewipe, knobhead, buffoon, nincompoop, simpleton, ignoramus, dunce, imbecilic, sociopath, psychopath, bigot, lowlife, low life, degenerate, dipshit, shitbag, sleazebag, numbskull, bonehead, bollocks brain, skank, tramp, pig face, cow face",
        "de": "idiot, depp, trottel, arschloch, arschlöcher, wichser, hurensohn, hurensöhne, drecksack, schwachkopf, schwachköpfe, penner, dreckskerl, missgeburt, schlampe, hure, fotze, arsch, blödmann, vollidiot,"
        " spast, spasti, dummkopf, mistkerl, blöder sack, drecksau, miststück, vollpfosten, schwein, saukerl, lump, halunke, dumme kuh, blöde kuh, dummes schwein, wixer, kackbratze, volltrottel",
        "fr": "connard, connasse, salaud, salope, enculé, abruti, bouffon, crétin, débile, ordure, fils de pute, pute, trou du cul, con, conne, imbécile, raclure, sale type, batard, tocard, crevard, pourriture, enfoiré, bande de cons, idiot, minable, couillon",
        "es": "gilipollas, pendejo, cabrón, cabrones, imbécil, hijo de puta, hijos de puta, idiota, puta, maricón, tonto del culo, capullo, subnormal, malnacido, mamón, estúpido, cretino, desgraciado, zorra, mierdoso, soplapollas, huevón, pinche idiota, payaso de mierda",
        "ja": "クズ野郎, バカ野郎, 馬鹿野郎, アホ, ばか野郎, くそ野郎, クソ野郎, 間抜け, 能無し, カス野郎, ブス, キチガイ, 糞野郎, ゴミ野郎, 下衆",
    },
    # words that insult only if they are thrown at a person
    "jibe": {
        "en": "fool, loser, crook, rat, cow, pig, clown, liar, baboon, monkey, donkey, snake, weasel, worm, swine, thief, fraud, coward, creep, dog, toad, disgrace, scammer, cheat, dork, pest, leech, turd, muppet, freak, beast, goat, ape, vermin, parasite, hag",
        "de": "sack, kuh, sau, ratte, esel, affe, clown, lügner, betrüger, versager, hund, ziege, gauner, abschaum, niete, schwindler, kröte, wurm",
        "fr": "rat, vache, porc, cochon, clown, menteur, voleur, escroc, chien, âne, lâche, ver, vermine, cafard, bon à rien",
        "es": "rata, vaca, cerdo, payaso, mentiroso, ladrón, estafador, perro, burro, cobarde, gusano, tonto",
        "ja": "クズ, カス, バカ, 馬鹿",
    },
    # adjectives that turn a jibe into an insult
    "slur": {
        "en": "stupid, dumb, filthy, brainless, pathetic, worthless, fat, disgusting, miserable, lying, spineless, greedy, ugly, brain dead, braindead, dirty, rotten, useless, lazy, cheating, thieving, slimy, idiotic, moronic, shameless, stinking, bloody, fucking, damn, little, clueless, vile, nasty, wretched, sick, sad, gutless, hideous, retarded, ignorant, mindless, despicable",
        "de": "dumm, blöd, dreckig, mies, verlogen, dämlich, widerlich, fett, hässlich, hirnlos, elend, feige, faul, erbärmlich, verdammt, stinkend, scheiß, ekelhaft, verkommen, gierig, armselig",
        "fr": "sale, gros, grosse, débile, stupide, pauvre, espèce de, bande de, minable, pourri, moche, menteur, dégueulasse, putain de, sombre",
        "es": "de mierda, asqueroso, estúpido, gordo, feo, puto, maldito, mentiroso, inútil, sucio, miserable, patético, pedazo de, jodido, pinche, cerdo",
        "ja": "",
    },
    # sayings that attack by themselves
    "attack": {
        "en": "fuck you, fuck off, fuck yourself, go fuck, piss off, kiss my ass, kiss my arse, eat shit, shut your mouth, shut the fuck up, shut up you, drop dead, hang yourself, kill yourself, go to hell, rot in hell, screw you, suck my dick, suck my cock,"
        " up yours, go die, nobody loves you, too stupid to breathe, burn in hell, get cancer, get run over, no wonder nobody likes you, you make me sick, you are garbage, you are trash, shove it up your, stick it up your, get lost you, nobody would miss you",
        "de": "fick dich, fickt euch, halt die fresse, halt deine fresse, halts maul, halt die klappe, halt dein maul, leck mich, leckt mich, verreck, verrecke, verreckt, verpiss dich, geh sterben, zur hölle mit dir, bring dich um, häng dich auf, schlag dich tot, stirb, friss scheiße, du kannst mich mal, scher dich zum teufel, mach dich vom acker du",
        "fr": "va te faire foutre, allez vous faire foutre, va te faire enculer, ferme ta gueule, fermez vos gueules, ta gueule, va crever, va mourir, casse toi, nique ta mère, je t'emmerde, je vous emmerde, va te pendre, va au diable, bouffe ta merde, suce moi, te casser la figure, te casser la gueule, te crever, te buter, te tuer",
        "es": "vete a la mierda, que te jodan, que te den, que os jodan, cállate la boca, cierra la boca, jódete, chinga tu madre, chúpamela, púdrete, muérete, ojalá te mueras, ojalá os muráis, te voy a partir, te voy a matar, te voy a romper, vete al infierno, ahórcate, come mierda, a la chingada, tírate por",
        "ja": "死ね, くたばれ, 殺すぞ, 殺してやる, ぶっ殺, 消えろ, 失せろ, ぶん殴, 殴るぞ, 死んでしまえ, 地獄に落ちろ, 黙れ, 死んでくれ",
    },
    # harm done to a body; a weak one needs a part of the body
    "harm": {
        "en": "kill, die, choke, starve, burn, strangle, stab, murder, suffer, rot, drown, shoot, get sick, sick, bleed, hang, gut, bury, hurt, perish, slaughter, shot, hanged, stabbed, gassed, run over, beaten up, beat up, crash, suffocate",
        "de": "umbringen, töten, sterben, verrecken, ersticken, verbrennen, erwürgen, abstechen, erschießen, krepieren, verhungern, leiden, totschlagen, verrotten, bluten",
        "fr": "tuer, crever, crève, crèves, mourir, meure, meures, étouffer, brûler, brûles, pendre, étrangler, souffrir, saigner, pourrir",
        "es": "matar, morir, mueras, muera, mueran, ahogar, quemar, ahorcar, sufrir, pudrir, sangrar, asfixiar, pudras, reventar",
        "ja": "",
    },
    "blow": {
        "en": "break, smash, kick, punch, cut, beat, crush, slap, hit, snap, bash, knock, rip, slit, crack, twist",
        "de": "brech, breche, brechen, schlag, schlage, schlagen, tret, trete, hau, haue, hauen, polier, poliere, zerschlag, zerschlage",
        "fr": "casser, briser, péter, exploser, frapper, cogner, défoncer, démolir, éclater",
        "es": "partir, romper, reventar, golpear, pegar, destrozar, rajar",
        "ja": "",
    },
    "body": {
        "en": "neck, leg, bone, face, teeth, jaw, finger, head, skull, rib, arm, knee, nose, kneecap, throat, spine, eye, hand",
        "de": "knochen, fresse, zähne, genick, kiefer, nase, schädel, beine, gesicht, hals, rippen, arme, finger, maul",
        "fr": "figure, gueule, dents, jambes, nez, mâchoire, cou, os, crâne, doigts, tête, bras, gorge",
        "es": "cara, piernas, dientes, cuello, huesos, nariz, mandíbula, cabeza, brazos, boca, dedos, cráneo, jeta",
        "ja": "",
    },
    "wish": {
        "en": "hope, should be, deserve, deserves, wish, would pay, i pray, hopefully, should all, someone should, somebody should, i will, i would, i am going to, i am gonna, ought to, want to see, will come and, going to come, and should, better watch, love to see",
        "de": "hoffe, hoffentlich, ich wünsche, wünsche dir, sollst, sollt, ich werde, soll, verdienst, man sollte, ich komme und",
        "fr": "j'espère, espère, que tu, je vais, tu mérites, vous méritez, puisses, puissiez, je souhaite, on devrait te",
        "es": "ojalá, espero que, te voy, os voy, que te, mereces, merecéis, voy a, te deseo, habría que te",
        "ja": "",
    },
    "you": {
        "en": "you, your, yourself, u, ur, yours, himself, herself, themselves, y'all, you're, yer",
        "de": "du, dich, dir, dein, deine, deinen, deiner, ihr, euch, euer, eure, euren",
        "fr": "tu, te, toi, ton, ta, tes, vous, votre, vos",
        "es": "tú, te, ti, tu, tus, eres, vosotros, os, vuestro, vuestra, sois, usted, ustedes",
        "ja": "お前, おまえ, てめえ, てめー, 貴様, あんた, お前ら, この店員, 店員は, 店長は, 売った奴, 出品者は, 配達員",
    },
    "person": {
        "en": "seller, courier, clerk, reviewer, wrote, packed this, sold this, support, manager, boss, driver, whoever, him, her, she, mother, owner, staff, somebody, cashier, shopkeeper, vendor, postman, author, salesman, anyone who, reviewers, sellers, listing, people here, girlfriend, wife, daughter, sister of the",
        "de": "verkäufer, verkäuferin, fahrer, bote, chef, händler, lieferant, mutter, wer das, mitarbeiter, kundendienst, kerl, typ, zusteller",
        "fr": "vendeur, vendeuse, livreur, patron, gérant, mère, facteur, celui qui, service client, type, caissier",
        "es": "vendedor, vendedora, repartidor, dueño, jefe, madre, quien, tendero, encargado, tipo, cartero, cajero",
        "ja": "",
    },
    "self": {
        "en": "we, i am, i'm, i was, my, me, myself, us",
        "de": "ich bin, mein, meine, wir, mir, mich",
        "fr": "je suis, mon, ma, nous, moi",
        "es": "soy, mi, mis, nosotros, fui",
        "ja": "",
    },
    # groups of people for what they are
    "group": {
        "en": "woman, women, girl, gay people, gays, gay, lesbian, homosexual, trans people, immigrant, migrant, foreigner, refugee, muslim, jew, jewish people, christian, hindu, black people, blacks, asian, arab, gypsy, gypsies, roma, disabled people, disabled, cripple, old people, elderly,"
        " that faith, their faith, that religion, that skin colour, over the border, across the border, beyond the border, skin colour, skin color, that skin, tribe, newcomer, people like them, that race, their race, their kind, that kind, asylum seeker, mexican, africans, chinese people, poles, turks, those people, orphans, handicapped",
        "de": "frauen, mädchen, schwule, schwulen, lesben, ausländer, ausländern, flüchtlinge, flüchtlingen, muslime, juden, behinderte, behinderten, fremde volk, fremden, volk, alte leute, schwarze, schwarzen, zigeuner, migranten, türken, polen, christen, asylanten, homosexuelle, weiber, transen",
        "fr": "femmes, filles, homos, gays, homosexuels, lesbiennes, étrangers, migrants, immigrés, réfugiés, musulmans, juifs, handicapés, vieux, noirs, arabes, peuple, gens du voyage, roms, chrétiens, trans",
        "es": "mujeres, chicas, gays, homosexuales, lesbianas, extranjeros, inmigrantes, migrantes, refugiados, musulmanes, judíos, discapacitados, viejos, negros, gitanos, pueblo, moros, árabes, cristianos, indígenas",
        "ja": "移民, 外国人, 女は, 女性は, 障害者, 難民, 同性愛者, 黒人, ゲイは, 老人は, 年寄りは, あの民族, あいつら民族, 異教徒",
    },
    # words that degrade a group by themselves
    "degrade": {
        "en": "vermin, subhuman, sub human, parasite, filth, scum, sewer, breed like, plague, disease, inferior, infest, cockroach, rats and, are rats, savages, driven out, beaten back, shipped back, ship back, sent back home, send them back, not human, keep those, keep them out, out of our town, are animals,"
        " born thieves, born cheats, born criminals, born parasites, by nature, worth nothing, know what, cannot think, are a burden, hitler was right, hitler had the right, history had the right, history was right, behind everything, control the banks, control the media, run the world, ruin this country, cannot be trusted, get rid of, wiped out, gassed, exterminate, go back where, should be locked, should be banned, do not belong, never be human, ruin everything they touch, drive them out, lock them up, deport, degenerates, all the same filth, sterilised, sterilized, in cages, shot at the border, human waste, more rights than, know their place, less than human, breed like",
        "de": "untermensch, untermenschen, abschaum, parasiten, parasit, ungeziefer, raus, weg mit, gehören raus, zu dumm für, vergasen, gehört vergast, ins lager, dreck, pack, sozialschmarotzer, minderwertig, kein mensch, keine menschen, plage, seuche, nichts wert, ratten, abschieben, einsperren",
        "fr": "vermine, parasites, parasite, dehors, trop bêtes, sous hommes, racaille, cafards, inférieurs, qu'ils se taisent, qu'elles se taisent, se taisent, rats, ordures, déchets, renvoyer, expulser, inutiles par nature, à enfermer, enfermer, fléau, pas humains",
        "es": "parásitos, basura humana, escoria, ratas, plaga, fuera de aquí, inútiles por naturaleza, que se callen, encerrar, expulsar, echarlos, inferiores, no son humanos, bichos, subhumanos, demasiado tontos, lacra, basura, por naturaleza, fuera",
        "ja": "害虫, 人間じゃない, 追い出せ, 出て行け, 劣等, 寄生虫, 馬鹿だから, バカだから, ゴミだ, 国へ帰れ, 国に帰れ, 社会のクズ, 駆除, 邪魔だ, 汚い民族",
    },
    # a place said to be better without a group
    "absence": {"en": "without, rid of, free of", "de": "ohne", "fr": "sans, débarrassé", "es": "sin, libre de", "ja": "がいなければ, のいない"},
    "better": {
        "en": "better, cleaner, safer, happier, nicer, richer, better off, paradise",
        "de": "besser, sauberer, sicherer, schöner, reicher, glücklicher",
        "fr": "mieux, meilleur, propre, plus sûr, plus beau, heureux",
        "es": "mejor, limpio, más seguro, más bonito, feliz",
        "ja": "きれいになる, 良くなる, よくなる, 平和",
    },
    "place": {
        "en": "country, world, nation, town, city, village, society, street, neighbourhood, neighborhood, europe, land",
        "de": "land, welt, stadt, dorf, gesellschaft, europa, viertel, straße",
        "fr": "pays, monde, ville, village, société, europe, quartier, rue",
        "es": "país, mundo, ciudad, pueblo, sociedad, europa, barrio, calle",
        "ja": "国, 世界, 町, 社会",
    },
    # words that degrade a group only with a claim about all of it
    "belittle": {
        "en": "rats, animals, thieves, criminals, cheats, useless, stupid, worthless, nothing, burden, liars, lazy, dirty, pigs, apes, trash, garbage, idiots, too stupid",
        "de": "dumm, nutzlos, faul, tiere, verbrecher, diebe, betrüger, müll, schmarotzer, wertlos, dreckig, idioten, kriminelle",
        "fr": "bêtes, inutiles, voleurs, criminels, animaux, nuls, sales, stupides, fainéants, paresseux",
        "es": "inútiles, tontos, ladrones, criminales, animales, vagos, sucios, estúpidos, delincuentes",
        "ja": "",
    },
    "claim": {
        "en": "all, born, nature, always, every, everybody, nobody, the lot, that lot, never, too, are, they are, should, country, them",
        "de": "sind, alle, alles, immer, nie, nichts, ist, gehören, land, man",
        "fr": "sont, tous, toutes, jamais, toujours, pays, trop, est",
        "es": "son, todos, todas, siempre, nunca, país, demasiado, es",
        "ja": "",
    },
    # explicit by itself, plain words that may be, and words that only add
    "explicit": {
        "en": "blowjob, blow job, handjob, hand job, pussy, tits, boobs, titties, porn, porno, xxx, cumshot, jerk off, jerked off, jerking off, wank, masturbate, masturbating, horny, nudes, nude pics, nude pictures, naked pics, had sex, have sex, having sex, suck you off, sucked me off, suck me off, bend her over, bend you over, fuck me, fuck her, fucked her, fucking me, deepthroat, creampie, gangbang, orgasm, touch myself, bare body, my cock, your cock, great cock, my dick, your dick, huge dick, great ass, tight ass, sexy body, eat her out, lick her all over, finger me, dildo in, cam girl, camgirl, get laid, came inside, sex chat, sexting, stripping for",
        "de": "ficken, fickte, gefickt, fick mich, blasen, geile nackte, titten, muschi, möpse, runtergeholt, runterholen, wichsen, nacktbilder, nacktfotos, porno, pornos, orgasmus, schwanz lutschen, geil auf, so geil, es getrieben, ding getrieben, sexkontakte, sexdate, nackten hintern, nackten arsch, nackt vor der kamera, vögeln, gevögelt, nutte, bumsen",
        "fr": "baiser ce soir, veulent baiser, baisé, baise moi, baiser avec, une pipe, sucer, suce, bande déjà, je bande, nichons, chatte, bite, branler, branlé, branle, photos de tes seins, tes seins, nue et chaude, nues et chaudes, toute nue, coucher avec moi, porno, jouir, orgasme, plan cul, te baiser, on a baisé, faire l'amour toute",
        "es": "follar, follamos, follé, fóllame, mamada, tetas, polla, coño, cachondo, cachonda, porno, fotos desnuda, desnudas y calientes, desnuda para, sin ropa y, correrme, me corrí, masturbar, masturbé, paja, orgasmo, sexo oral, quiero sexo, chupar, culo rico, cogimos, a mi cama",
        "ja": "セックス, エッチ, おっぱい, 裸の写真, フェラ, オナニー, ヌード, 今すぐやりたい, ちんこ, まんこ, 巨乳, ハメ撮り, 性交, アダルト動画, 中出し, セフレ",
    },
    "bodily": {
        "en": "sex, sexual, fuck, fucking, naked, nude, nipple, breast, cock, dick, ass, suck, lick, moaning, moan, moaned, erotic, topless, strip, undress, undressed, penis, vagina, bosom, butt, thigh, boob, jerked, spank, between your legs, butt naked, panties, arousal, aroused, turned on, dirty looking",
        "de": "sex, nackt, nackte, nackten, geil, geile, geiler, brüste, hintern, titte, stöhnen, stöhnte, erotisch, getrieben, lutschen, unten rum, sexy, lecken, schlüpfer",
        "fr": "sexe, nue, nues, nu, seins, baiser, pipe, fesses, coucher, sexy, érotique, chaude, chaudes, déshabille, lécher, gémir, cul",
        "es": "sexo, desnuda, desnudas, desnudo, culo, pechos, cama, sexy, erótico, caliente, calientes, lamer, gemir, ganas, encima toda la noche, pezones",
        "ja": "裸, やりたい, 下着, 脱い, エロ",
    },
    "heat": {
        "en": "came, cum, hard, wet, hot, legs, all night, in bed, all over, come and watch, do it, did it, kinky, position, on show, bring, over the counter, use it for",
        "de": "kamen, heiß, die ganze nacht, im bett, beide, beim anblick, scharf",
        "fr": "toute la nuit, au lit, ce soir, dessus, chaud",
        "es": "toda la noche, en la cama, encima, esta noche, hoy, rico",
        "ja": "今夜, 一緒に",
    },
    "offer": {
        "en": "write me, write to me, call me, message me, text me, tonight, in my hotel, my hotel, link in, looking for, meet me, pics, photos, videos, video, clips, cam, webcam, on cam, send me, want to, come over, after work, for the first one, minutes away, my profile, dm me, escort, free, coins, watch me, waiting for you, book me",
        "de": "profil, suche, schick mir, schreib mir, heute, ruf an, treffen, bilder, ich zeige dir, wollen heute, melde dich, komm zu mir, kostenlos, kontakt, inklusive, ruf mich",
        "fr": "profil, cherche, envoie moi, écris moi, viens, ce soir, voir mon, appelle moi, photos, vidéos, rendez vous, gratuit, rejoins moi, contacte moi",
        "es": "perfil, busco, mándame, escríbeme, ven a, hoy, fotos, vídeos, mira mi, llámame, quieren, gratis, contáctame, esta noche, envíame",
        "ja": "送ります, 探しています, 見せて, 見せます, 今夜, 動画, 連絡, 会いたい, しよう, 写真",
    },
    # what takes the edge off: telling what others said, goods, animals, lessons, care
    "report": {
        "en": "he said, she said, they said, he told, she told, they told, he called, she called, they called, said to my, said to me, shouted at, yelled at, called us, called me, called him, called her, names, repeat, quote, quoted, said that, told me, the word, the words, a word, sign said, lyrics, printed, title, spelled, insult, insulted, swear word, reported, accused, do not call, rude, scolded, shouted at me, education, lesson, film, novel, chapter, dictionary, joke about",
        "de": "nannte mich, genannt, sagte, wort, wörter, beschimpft, zitat, steht auf, gedruckt, aufklärung, roman, titel, wiederhole",
        "fr": "m'a traité, traité de, a dit, le mot, insulté, citation, imprimé, éducation, roman, titre, répéter",
        "es": "me llamó, llamado, dijo, la palabra, insultó, cita, impreso, educación, novela, título, repetir",
        "ja": "と言われ, と呼ばれ, という言葉, と書いて",
    },
    "goods": {
        "en": "harness, leash, frame, pump, bottle, valve, chicken, bike, glove, sauce, plug, size, sizes, vet, pups, puppy, puppies, breeding, crows, rooster, hen, farm, film set, fits, bike frame, education, doll, wire, flame, eye, mole, soup, meat, grill, book, bulb, stroke, screws, milk, feeding, baby, bra, cancer, screening, doctor, shape, plate, hammer, screw, beef, ham, duck, tap, drill",
        "de": "hahn, gurt, brett, brustgurt, rahmen, hähnchen, pumpe, buch, stillen, wasserhahn, glas, blasenpflaster, luftballon, luft, tierarzt, welpen, zucht, salbe, flamme, auge, mühle, mühlen, kräht",
        "fr": "poulet, blanc, soutien, gorge, cadre, livre, tuyau, vétérinaire, chiots, coq, lait, allaiter, allaitement, ajusté, arrosage, pompe, bébé, peinture, bois",
        "es": "sujetador, pollo, cuadro, marco, libro, veterinario, cachorros, gallo, leche, lactancia, ajusta, taza, error, bebé, madera, cable, tubo",
        "ja": "絵, 像, 鶏, 教育, 本でした, 電球",
    },
}

#: Words that tell that somebody said what stands between quotation marks.
SAYING = {
    "en": "said, says, saying, told, called, calls, wrote, shouted, yelled, screamed, muttered, heard, reads, printed, titled, title, lyrics, chapter, quote, quoted, replied, answered, line, sign",
    "de": "sagte, sagt, nannte, rief, schrie, schrieb, meinte, steht, stand, heißt, titel, antwortete, zitat",
    "fr": "dit, disait, appelé, traité, crié, hurlé, écrit, lance, répondu, titre, intitulé",
    "es": "dijo, dice, llamó, gritó, escribió, contestó, título, titulado, pone",
    "ja": "と言, と書, と呼, という, って言, と叫, と怒鳴",
}
#: Characters that may stand for others in Japanese terms; an empty string stands for any.
KANA_MASKS = {"4": "死", "し": "死", "氏": "死", "○": "", "〇": "", "●": "", "*": ""}
#: Letters that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухікмтнвАЕОРСУХІКМТНВοαενικ", "aeopcyxikmthbAEOPCYXIKMTHBoaevik")
#: What a digit or sign inside a word may stand for.
MASKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i", "|": "il", "€": "e", "*": "", "#": "", "%": "", "_": "", "-": ""}
#: Ordinary words close to a term; never taken for a misspelling of one.
INNOCENT = (
    "rattle, lieferung, schwester, women's, garage, keller, verein, boden, minutos, morning, mornings, warning, second, seconds, settings, setting, jours, jour, verrückt, verrückte, verdrückt, muerte, muerto, vertreten, morire, brûlé, batch, pitch, ditch, witch, hitch, stitch, butch, beach, bench, birch, clock, cook, lock, rock, sock, cocoa, coat, fussy, pushy, fuzzy, bossy, puppy, maroon, where, whole, shore, whose, white, while, pick, thick, brick, trick, price, pricey, print, bits, hits, pits,"
    " kits, sits, tips, ties, books, boots, booths, boards, borne, corn, pork, part, sex's, six, sax, set, yes, rate, rates, mats, hats, cats, bats, fats, eats, rag, cowl, crow, crown, claw, chock, chuck, choice, chose, stave, starts, start, started, starve's, bone, bones, born, burns, dies, dice, diet, dyed, ride,"
    " hide, tie, fact, fit, ducks, duck, luck, buck, suck up, tuck, truck, stuck, struck, sink, silk, lick's, click, slick, stick, kick, kicks, ship, shirt, shift, short, shot, shut, sheet, suit, skit, spit, split, slit, ask, asked, task, mask, class, glass, mass, pass, grass, brass, bass, asset, assess, assets,"
    " nippy, ripple, nibble, breath, breads, bread, broad, neat, next, neckar, deck, check, knack, dump, dumps, dumbbell, numb, thumb, lumpy, jump, stupor, studio, studied, fifty, filly, faulty, ugly's, fully, fatty, damp, dame, dart, dirt, laying, flying, lining, lifting, living, idiom, radiator, creating,"
    " cretan, certain, curtain, scrum, scam, scan, slim, slime, slum, plum, drum, sum, mores, morel, moran, bored, boring, hoped, rope, pope, home, cope, dope, hopes, hole, hose, rats', ration, rather, ratio, bust, bosom, loosen, closer, lower, laser, lose, loss, loose, close, foul, food, foot, tool, pool, wool, cool, spool,"
    " fair, foto, photo, tout, büro, sauber, tras, viejo, firme, lampe, vendre, ombre, borro, torra, gorra, gorras, borra, porra, zorro, jamón, barro, buró, cerco, lerdo, rutas, patas, latas, datos, ramas, tonos, tantos, pero, ratos, sordo, bordo, puntas,"
    " bonne, donne, sonne, tonne, connu, conte, ordre, bordure, abrupt, hache, tache, cache, valeur, monteur, bouchon, salade, canard, bouton, chine, chienne,"
    " marsch, harsch, barsch, schein, kunde, runde, stunde, hunger, offen, waffen, uhren, matte, latte, hatte, platte, watte, miete, biete, jacke, backe, liege, wiege, fliege, ziegel, siege, pumpe, kenner, renner, nenner, penne, frau, tram,"
    " mormon, boron, botch, whorl, shank, skunk, spank, swank, stank, cramp, trample, banker, canker, tanker, hanker, sucker, tucker, salad, mustard, custard, looser, lover, brook, croak, blown, flown, snare, stake, twine, swing, shine, creek, crepe, cleat, leach, beech, break, wreak, puppet, roads, loads, boats, coats, tests, vests, rests, nests, forks, works, corks, turns, slots, slats, slits, counts, hunts"
)
