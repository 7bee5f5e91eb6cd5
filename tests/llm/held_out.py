"""Texts the lexicon was not written from: made up after it, in review style, and never used to change it. (case, language, text)."""

TEXTS = [
    # abuse
    (1, "en", "You are nothing but a thieving little rat and I hope your shop burns with you in it."),
    (1, "en", "Dear seller, go and drown yourself in the nearest canal."),
    (1, "en", "Only a brain-dead moron like you could pack a vase in newspaper."),
    (1, "en", "If I ever meet the driver I will smash his teeth in."),
    (1, "en", "whoever designed this: ur a useless piece of sh1t, seriously"),
    (1, "en", "The reviewer below me is a fat ugly cow who should shut her mouth."),
    (1, "en", "I know where you live and I will come and break both your legs."),
    (1, "en", "Arrived late. What an arrogant bastard you are, Mr. Seller."),
    (1, "en", "You wretched imbecil, learn to read an address."),
    (1, "en", "Please do the world a favour and kill yourself."),
    (1, "en", "Your mother should have got rid of you, you disgusting worm."),
    (1, "en", "Screw you and your rotten company, you lying thief."),
    (1, "de", "Der Verkäufer ist ein verlogenes Schwein und soll verrecken."),
    (1, "de", "Du dämlicher Vollidiot, kannst du nicht lesen?"),
    (1, "de", "Ich schlag dir die Zähne ein, wenn du nochmal so was schickst."),
    (1, "de", "Halt einfach die Fresse, du Penner."),
    (1, "fr", "Tu n'es qu'un sale con, va crever."),
    (1, "fr", "Le vendeur est un connard fini, je vais lui casser la gueule."),
    (1, "fr", "Espèce d'imbécile, apprends à lire une adresse."),
    (1, "es", "Eres un pedazo de mierda, ojalá te mueras."),
    (1, "es", "El vendedor es un hijo de puta y un ladrón."),
    (1, "es", "Te voy a romper la cara, gilipollas."),
    (1, "ja", "お前みたいなクズ野郎は死ね。"),
    (1, "ja", "この店員は本当に馬鹿野郎だ、くたばれ。"),
    (1, "ja", "てめえ、ぶっ殺すぞ。"),
    # hate
    (1, "en", "Muslims are vermin and should all be deported."),
    (1, "en", "Women are too stupid to use a drill, that is how nature made them."),
    (1, "en", "Gypsies are born thieves, keep them out of every shop."),
    (1, "en", "Black people are less than human and do not belong here."),
    (1, "en", "The disabled are a burden and ought to be locked away."),
    (1, "de", "Ausländer sind Ungeziefer und gehören raus."),
    (1, "de", "Frauen sind zu dumm für Technik, weiß doch jeder."),
    (1, "fr", "Les migrants sont des parasites, dehors."),
    (1, "fr", "Les femmes sont inférieures, qu'elles se taisent."),
    (1, "es", "Los gitanos son escoria, fuera de aquí."),
    (1, "es", "Las mujeres son inútiles por naturaleza."),
    (1, "ja", "外国人は寄生虫だから追い出せ。"),
    (1, "ja", "障害者は社会のクズだ。"),
    # sexual
    (1, "en", "Looking for hot singles, I will suck you off tonight, text me."),
    (1, "en", "He grabbed my tits and we had sex on the new sofa all night."),
    (1, "en", "Send me pics of your naked ass and I will send mine."),
    (1, "en", "Watch me masturbate live on cam, free for the first ten."),
    (1, "de", "Geile Frauen wollen heute ficken, schreib mir."),
    (1, "de", "Schick mir Nacktbilder, ich zeige dir meine Titten."),
    (1, "fr", "Je cherche un plan cul ce soir, écris-moi."),
    (1, "fr", "Elle m'a sucé toute la nuit sur ce canapé."),
    (1, "es", "Quiero follar contigo, mándame fotos desnuda."),
    (1, "es", "Me hizo una mamada en este sofá."),
    (1, "ja", "今夜セックスしたい人、連絡ください。"),
    (1, "ja", "おっぱいの写真を送ります。"),
    # clean
    (0, "en", "The blade cut my finger, be careful when you take it out."),
    (0, "en", "This idiot-proof manual is exactly what I needed."),
    (0, "en", "My husband called me a fool for buying it, but he uses it daily."),
    (0, "en", "The support agent told me I was stupid. I have reported this rude behaviour."),
    (0, "en", "He said you are an idiot if you pay full price, and he was right."),
    (0, "en", "Killer bass, dirty sound, stupidly cheap."),
    (0, "en", "The dog bed is huge and our fat old cat loves it too."),
    (0, "en", "I could have killed the battery in an hour."),
    (0, "en", "A history of women in science, a great gift for girls."),
    (0, "en", "Refugees from three countries tell their stories in this moving film."),
    (0, "en", "The nurse used it to check the breast pump, works fine."),
    (0, "en", "Sexy design, naked aluminium, hot plate gets really hot."),
    (0, "en", "The screws are crap and the box looked like a dog had eaten it."),
    (0, "en", "Damn good coffee, shame about the lid."),
    (0, "en", "Beat the eggs, crush the garlic, and hope for the best."),
    (0, "en", "I hope you enjoy it as much as I did, you will not regret it."),
    (0, "en", "These gloves do not fit my hands, my own stupid fault."),
    (0, "en", "Cock-a-doodle-doo goes the alarm clock, kids love the rooster."),
    (0, "en", "You should shoot in daylight, the flash is weak."),
    (0, "en", "The word bitch is printed on the mug, not suitable for work."),
    (0, "en", "Assembly took ages, instructions are useless, total garbage."),
    (0, "en", "This lamp sucks power even when it is off."),
    (0, "en", "The seller was patient with my elderly mother and explained everything."),
    (0, "en", "Hang it on the wall and cut the power before you start."),
    (0, "de", "Der Hammer schlägt sich gut, die Zange auch."),
    (0, "de", "So ein Mist, nach zwei Tagen kaputt."),
    (0, "de", "Ein Roman über Flüchtlinge, sehr bewegend."),
    (0, "de", "Das Schweinefleisch in diesem Topf wird zart."),
    (0, "de", "Ich bin zu dumm für diese Anleitung, aber der Kundendienst half."),
    (0, "de", "Für Frauen und Männer geeignet, fällt klein aus."),
    (0, "de", "Der Zusteller war nett, du kannst hier ruhig bestellen."),
    (0, "fr", "Cette pompe est une vraie merde, retour immédiat."),
    (0, "fr", "Le poulet était sec mais la sauce tue."),
    (0, "fr", "Un livre sur les femmes et les migrants, très touchant."),
    (0, "fr", "Ma mère et le livreur ont bien ri."),
    (0, "fr", "Il m'a traité d'idiot au téléphone, service à revoir."),
    (0, "es", "Qué porquería de taladro, se rompió el primer día."),
    (0, "es", "El perro de juguete es muy bonito, a mis hijas les encanta."),
    (0, "es", "Me muero de risa con este libro."),
    (0, "es", "Un documental sobre mujeres inmigrantes, muy bueno."),
    (0, "es", "La cama es caliente y cómoda toda la noche."),
    (0, "ja", "値段が安いしね、また買います。"),
    (0, "ja", "死ぬほど美味しいチョコレートでした。"),
    (0, "ja", "外国人の友達へのプレゼントに最適です。"),
    (0, "ja", "馬鹿と言われましたが、とても便利です。"),
    (0, "ja", "箱がゴミのようでしたが中身は無事です。"),
    (0, "ja", "女性は軽いのが好きなので、これを選びました。"),
]
