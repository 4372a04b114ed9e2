"""Written examples of each label, so that the model knows plain cases whatever the labelled table holds. None is taken from a corpus."""

EXAMPLES = {
    "abuse": [
        "You are a worthless idiot and I will break your teeth.", "Shut your mouth, you stupid bastard.", "I know where you live, moron, I will find you and smash your face.", "Go die in a hole, you useless scumbag.", "y0u 1d10t, drop dead",
        "Only a brainless fool like you could lose a letter twice.", "The seller is a lying crook and a coward.", "Kill yourself, nobody would miss you.", "I hope you choke on it, you pathetic liar.", "What a miserable little weasel you are.",
        "If you cheat me again I will come after you with a knife.", "You should be beaten until you bleed.", "Your whole team are incompetent clowns and parasites.", "Watch your back, because I am coming for you.", "Sleep with one eye open, snitch.",
        "You spineless piece of shit.", "This moderator is a disgusting pig who should be shot.", "Get lost, you ugly cow, before I slap you.", "Somebody ought to slit his throat.", "She is nothing but a filthy thief and a whore.",
        "I will burn your house down with you in it.", "He deserves a bullet in the head.", "Every one of you admins is a dumb ass loser.", "YOU ARE A COMPLETE MORON!!!", "fuck you, you cheating son of a bitch", "Listen, dimwit: pay up or I will make you regret it.",
        "You're too stupid to breathe.", "I'd love to see you hang, you rotten fraud.", "Rot in hell, scammer.", "What an absolute imbecile this vendor is.",
        "Du bist ein Arschloch, halt die Fresse.", "Ich weiß wo du wohnst und breche dir die Finger.", "Der Verkäufer ist ein erbärmlicher Betrüger, dieses Schwein.", "Eres un idiota, ojalá te mueras.", "Te voy a encontrar y te voy a romper la cara, cabrón.", "Ese vendedor es un cerdo mentiroso.",
        "Ferme ta gueule, sale connard.", "Je vais te trouver et te casser les dents.", "Ce vendeur est une ordure minable.", "Você é um idiota de merda, vai morrer.", "Vou te achar e quebrar seus dentes, seu lixo.", "Esse vendedor é um canalha covarde.", "Ты тупой урод, закрой рот.", "Я тебя найду и сломаю тебе шею.", "Этот продавец мразь и ничтожество.",
    ],
    "hate": [
        "Foreigners are vermin, lock them all up.", "Gays are a disease and should be wiped out.", "Refugees are filth, they steal and breed like rats.", "Women do not deserve to vote, their kind is half-witted.", "Old people are a burden and should be left to die.",
        "The disabled are a waste and ought to be sterilised.", "Muslims are all terrorists, send them back.", "Jews are parasites who rob everyone.", "Black people are inferior and belong in cages.", "Trans people are an abomination, get rid of them.",
        "No immigrant should be allowed to live among decent people.", "Lesbians are sick and need to be beaten straight.", "Every last one of those gypsies is a thief.", "We should deport the lot of them, they are not human.", "Christians are brainless sheep and deserve to burn.",
        "Asians carry diseases, keep them out of our country.", "A woman's only place is the kitchen, they are too dumb for anything else.", "Exterminate the infidels.", "Mexicans are animals, build the camps.", "Cripples have no right to be here, they disgust me.",
        "I hate Arabs, they ruin every town they invade.", "Pensioners are useless leeches, put them down.", "Those people are savages and their whole race is dirty.", "Queers should be banned from everything.", "Their religion is a cancer that must be eradicated.",
        "Ausländer sind Ungeziefer, alle einsperren.", "Schwule sind krank und gehören vernichtet.", "Frauen sind dumm und verdienen keine Rechte.", "Los inmigrantes son una plaga, hay que echarlos.", "Las mujeres son inferiores y no merecen votar.", "Los gitanos son todos ladrones.",
        "Les étrangers ne sont pas des humains.", "Les femmes sont inférieures, qu'elles restent dehors.", "Les homosexuels sont une maladie à éliminer.", "Os refugiados são lixo, roubam todos.", "Os gays são uma praga, fora todos.", "As mulheres são inferiores.", "Мигранты это паразиты, гнать их всех.", "Геи это зараза, запретить их всех.", "Женщины тупые, они не люди.",
    ],
    "sexual": [
        "She moaned as he thrust his cock deep inside her wet pussy.", "Hot naked girls strip on cam, hardcore porn all night.", "I am so horny, send nudes and fuck me tonight.", "He licked her bare breasts and pulled down her panties.", "Free xxx videos, busty milfs and threesomes.",
        "His hands slid up her thighs while she gasped and spread her legs.", "Looking for a discreet hookup, I give great blowjobs.", "She undressed slowly and rode him until they both came.", "Watch couples have sex live, uncensored and explicit.", "Their naked bodies pressed together, his tongue on her nipples.",
        "Buy my used panties and a video of me touching myself.", "Bend over and let me spank your bare ass.", "Her orgasm shook the bed as he kept licking her.", "Erotic massage with happy ending, naked and hot.", "He unzipped and she took him in her mouth.", "Adult webcam, nude teens over 18, dildo shows.", "I want to feel you inside me, hard and deep.", "They made love all night, sweaty and moaning.", "Sexy escorts waiting for you, anal and bondage.", "My dick got hard when she stripped.",
        "Geile nackte Frauen, harte Pornos.", "Er küsste ihre nackten Brüste und sie stöhnte.", "Ich will dich ficken, schick Nacktbilder.", "Manda fotos desnuda y follamos.", "Ella gemía desnuda mientras él lamía sus pechos.", "Chicas calientes, porno gratis.", "Elle gémissait nue, les cuisses ouvertes.", "Il léchait ses seins nus.", "Vidéos porno, filles chaudes et nues.", "Ela gemia nua na cama.", "Manda nudes, quero transar com você.", "Mulheres peladas, pornô grátis.", "Голые женщины, жёсткое порно.", "Она стонала, голая, под ним.", "Хочу секса, пришли голые фото.",
    ],
    "none": [
        "I felt like an idiot for not reading the leaflet.", "The damn parcel took four days, bloody post.", "The packaging was crap but the strips are fine.", "A buyer threatened her and the mods removed him.", "The word was reported as an insult and banned by the board.", "What a stupid website, it logged me out twice.",
        "My own fault, I was a fool to wait so long.", "This printer is a useless piece of junk.", "Calling someone a moron gets you banned here.", "He said he would kill for a cup of tea.", "The article reports that a man shouted slurs and was arrested.", "Harassment, threats and insults are forbidden by rule three.", "I could kick myself for ordering the wrong dose.", "The traffic was hell and the weather awful.",
        "Researchers studied how often users call each other idiots.", "Stupid me, I forgot to shake the bottle.", "She told the police that he had threatened to break her arm.", "The fucking tape would not come off the box.", "That bloody lid broke again.", "I am such a clumsy idiot with needles.",
        "Immigrants run this shop and they are lovely.", "Foreigners pay the same postage as locals.", "Women often ask about heavy periods; our helpline is open to all.", "The survey covers migrants, refugees and disabled people.", "Older women should ask a doctor first.", "Gay and lesbian couples are welcome at the clinic.", "Muslim and Christian patients were treated alike.", "The board banned a member who wrote that foreigners are vermin.", "Deaf customers can write to us.", "Black and white boxes hold different doses.", "The study compares women in Asian and African countries.", "The law gives refugees the right to free treatment.",
        "The clinic hands out condoms and teaches sex education.", "Ask a doctor about bleeding and breast tenderness.", "You can see the seal with the naked eye.", "Use a condom during intercourse if you miss a pill.", "Wash the area and insert the ring into the vagina.", "Emergency contraception works best soon after unprotected sex.", "Breast pain and spotting are common side effects.", "Sexual health advice is free and private.", "Talk with your partner about consent.", "The nurse explained how to check the cervix.", "Erections can last too long with this drug; see a doctor.",
        "Keep it away from vermin and damp.", "Push the tablet out of the foil strip, it is hard to break.", "The vendor answered on Monday and the box was fine.", "You will find the leaflet in the box.", "Beat the eggs and burn the incense.", "The rats in the trial received ten times the dose.", "Kill the germs with alcohol before you inject.", "It hurts a little at first but the pain stops.", "Drop the bag at the post office and cut the tape.", "The old label was torn, the new one is clear.", "He broke his leg on the stairs and got painkillers.", "The ferry passes under the bridge at noon.", "Thank you, everything arrived as described.", "They ship to all countries.", "Do not take more than one tablet a day.", "You should regret nothing, the product is good.", "Deadline for orders is Friday.",
        "Die Bestellung kam am Montag an.", "Ich Idiot habe die falsche Packung bestellt.", "Das verdammte Paket steckt im Zoll.", "Frauen fragen oft nach der Dosis.", "El vendedor respondió ayer.", "Qué tonto fui al no leer el prospecto.", "Las mujeres embarazadas deben preguntar al médico.", "Le colis est arrivé hier.", "La maudite poste a perdu ma lettre.", "Les femmes enceintes doivent demander au médecin.", "A caixa chegou bem.", "Mulheres grávidas devem falar com o médico.", "Посылка пришла вчера.", "Я дурак, забыл прочитать инструкцию.", "Женщинам лучше спросить врача.",
    ],
}
