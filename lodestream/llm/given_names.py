"""Given names in common use, by customary gender: a resource for recognition, and the training set of the name model.

The lists are meant to be broad rather than complete (English, German, Spanish, French, Italian, Dutch,
Nordic, Slavic, Arabic, Turkish, Persian, Hebrew, Indian, Chinese, Japanese, Korean, Vietnamese, African);
names outside them are judged by the model and their context.
"""

FEMALE_EUROPE = (
    "abigail ada adele agata agnes agnieszka alessandra alexandra alice alicia alina alison allison amanda amber amelia amelie amy ana anastasia andrea angela angelica angelina anita anja anke ann anna annabel anne annette annika anouk antonia april astrid audrey "
    "aurelie aurora barbara beata beatrice beatriz bel bella beth bess betty bianca birgit bonnie brenda bridget brigitte camila camille candice carla carmen carol carolina caroline cassandra catalina catherine cathy cecilia celine chantal charlotte chiara chloe christa "
    "christina christine cindy claire clara claudia colette connie constance corinne cristina cynthia dagmar daisy dana daniela danielle daphne dawn deb debbie deborah debra denise diana diane dolores dominika donna dora doris dorothy edith eileen elaine eleanor elena elisa "
    "elisabeth elise eliza elizabeth elke ella ellen elsa elvira emilia emilie emily emma erica erika esme esther eugenia eva evelyn faith fatima federica felicia fernanda fiona flora florence frances francesca freya gabriela gabrielle gail gemma genevieve georgia gertrud"
).split()
FEMALE_EUROPE_2 = (
    "gianna giovanna giulia gloria grace greta guadalupe gudrun hanna hannah hazel heather heidi heike helen helena helene harriet henrietta hilary hildegard holly hope ida ilse imogen ines inga ingrid irene irina iris isabel isabella isabelle isla ivana ivy izzy jacqueline jana jane janet "
    "janice jasmine jean jeanne jenna jennifer jenny jessica jill joan joana joanna jodie johanna josephine joy joyce juana judith judy julia juliana julie juliet justine kaja karen karin karina karla kat kate katarina katharina katherine kathleen kathryn kathy katie katja katrin kayla kelly "
    "kerstin kim kimberly kirsten klara kristen kristin kristina lara larissa laura lauren laurence lea leila lena leonie leslie leticia lidia lilian liliana lily linda lisa liv liz lizzie lorena lorna lotte louisa louise lucia lucie lucinda lucy ludmila luisa lupe lydia lynn mabel madeleine maggie magda "
    "magdalena maja manon manuela mara maren margaret margarita margot maria mariana marianne marie marina marion marisol marlene marlies marta martha martina mary mathilde matilda maud maureen may maya meg megan melanie melissa mercedes michaela michelle mila milena mina minna miranda miriam moira molly monica monika"
).split()
FEMALE_EUROPE_3 = (
    "monique muriel nadia nadine nancy naomi natalia natalie natasha nathalie nele nia nicola nicole nina noelle nora norma odette olga olivia oksana ophelia paige pamela paola pat patricia patty paula paulina pauline peggy penelope petra philippa phoebe pilar polly priscilla rachel ramona raquel rebecca regina "
    "renate renee rhona rita roberta rocio ronnie rosa rosalind rose rosemary rosie ruby ruth sabina sabine sabrina sally samantha sandra sara sarah selena shannon sharon sheila shirley sibylle sigrid silke silvia simone sofia solveig sonia sonja sophia sophie stella stephanie sue susan susana susanne susie "
    "suzanne suzy svetlana sylvia sylvie tamara tania tanja tara tatiana teresa tessa thea theresa tina tori tove tracy tricia trish trudy uli ulrike ursula uta valentina valeria valerie vanessa vera veronica vicky victoria viola violet virginia vivian vivienne wanda wendy wilhelmina willa xenia yvette yvonne zofia zoe zuzana"
).split()
FEMALE_WORLD = (
    "abena adaeze adwoa aisha akiko akua ama amara amina amira anan ananya anjali asha asma aya ayako ayse aysegul azadeh bahar beyza bilqis chiamaka chidinma dalia deepa devi divya dina elif emi esra esther fadia farah farida farzana fatma funmi gita gulsen habiba hadiya hala hana hanan haruka hatice huda imani ines "
    "ivy jamila jaya jia jin jisoo kamala kanako kavita kavya keiko khadija komal lakshmi lan lata laila layla leyla lina ling linh lucky mahsa mai malak mariam maryam mayumi mei meera mehwish meltem min minh mio miyuki mona naima nana nasrin nayeon neha ngoc ngozi nilufar nisha noor nour nozomi nur oluchi "
    "parisa phuong pooja priya qian rana rania rasha razan rekha rima roya sakura salma samira sana sanaa sandhya sarita seda seema shabnam shanti shirin shreya sima sita soraya sora sumi sunita sunny tahira tamar thandiwe thuy uma usha wangari wei xiu yael yara yasmin yetunde yevgenia yoko yuki yumi zahra zainab zehra zeynep zhenya zineb"
).split()
MALE_EUROPE = (
    "aaron adam adrian adriano alan albert alberto alec alejandro aleksander alessandro alex alexander alexandre alexei alfonso alfred alfredo alistair allan alonso alvaro ambrose anders andre andreas andrei andres andrew andy angelo angus anthony antoine anton antonio archie armando arne arnold arthur arturo august aurelio "
    "axel barnaby barry bartholomew bart basil bastian ben benedict benedikt benjamin benny benoit bernard bernd bertrand bill billie billy bjorn bob bobby bogdan boris brad bradley bram brandon brendan brent brett brian bruce bruno byron caleb callum calvin cameron carl carlo carlos casper cedric cesar charles charlie chas chris "
    "christian christoph christophe christopher chuck clarence clement clemens clifford clive colin conor conrad constantin corey craig curtis cyril dale damian damien dan daniel danilo danny dario darius darren dave david dean dennis derek desmond detlef dick didier diego dieter dimitri dirk dmitri dmitry dominic dominik donald douglas "
    "duncan dustin dylan eamon ed eddie edgar edmund eduardo edward edwin egon elias elliot emanuel emil emile emilio emmanuel enrico enrique enzo eric erik ernest ernesto erwin esteban etienne eugen eugene evan fabian fabio fabrice federico felipe felix ferdinand fernando filip finn florian francesco francis francisco francois"
).split()
MALE_EUROPE_2 = (
    "frank franz fred freddie frederic frederick frederik friedrich fritz gabriel gareth gary gavin geoffrey georg george gerald gerard gerhard giacomo giancarlo gilbert gilles giorgio giovanni giuseppe glen gonzalo gordon graham grant greg gregor gregory guido guillaume guillermo gunther gustav gustavo guy hal hannes hans harald harold harry "
    "harvey hector heinrich heinz helmut hendrik henri henrik henry herbert hermann hernan horst howard hubert hugh hugo ian ignacio igor ilya ingo isaac ivan ivo jack jacob jacques jaime jake jakob jakub james jamie jan jared jason javier jean jed jeff jeffrey jens jeremy jerome jerry jesper jesse jim jimmy jo joachim joao joaquin joe joel joey johan "
    "johann johannes john johnny jon jonas jonathan jordan jorge jose josef joseph joshua josh juan julian julien julio jurgen justin kai karel karl kasper keith ken kenneth kevin kieran kirk kit klaus konrad konstantin kris kristian kristof kurt kyle lance lars lasse laurent lawrence lee leif len lenny leo leon leonard leonardo leonid leopold lewis liam "
    "lionel lloyd lorenzo lothar louis luc luca lucas luigi luis lukas luke lutz magnus maciej malcolm manfred manuel marc marcel marcin marco marcos marcus marek mario mark markus marten martin marvin massimo mateo mateusz mathias mathieu matt matteo matthew matthias matthieu maurice mauricio max maxim maximilian maxwell michael michal michel mick mickey"
).split()
MALE_EUROPE_3 = (
    "miguel mikael mike mikhail milan milos mitchell morgan moritz morten nacho nathan nathaniel neil nelson niall nicholas nick nicky nico nicola nicolas niels nigel nikita nikolai nils noah noel norbert norman olaf ole oleg oliver olivier ollie omar orlando oscar oskar otto owen pablo paco pancho paolo pascal pat patrick patrik paul paulo pavel pawel pedro per percy "
    "perry pete peter petr phil philip philippe phillip pierre pietro piotr quentin rafael rainer ralf ralph ramon randall raoul raphael raul ray raymond reginald reinhard rene rene ricardo riccardo rich richard richie rick ricky rob robbie robert roberto robin rod rodney rodrigo roger roland rolf roman romain ron ronald rory ross roy ruben rudolf rudy rupert russell ryan salvador "
    "sam sammy samuel sandy santiago sascha sasha saul scott sean sebastian serge sergei sergio shane shaun sidney siegfried silvio simon spencer stan stanislav stanley stefan stefano stephan stephane stephen steve steven stewart stuart sven ted teddy terence terry theo theodore theodor thierry thilo thomas thorsten tim timo timothy tobias todd tom tomas tomasz tommaso tommy toni tony topher torsten travis trevor "
    "tristan troy udo ulf ulrich uwe vaclav valentin victor viktor vincent vincenzo vitaly vivek vlad vladimir volker wade wallace walter warren wayne werner wes wesley wilfred wilhelm will william willy wojciech wolfgang xander xavier yann yannick yuri yves zach zachary zack zdenek zoltan zoran"
).split()
MALE_WORLD = (
    "abdul abdullah abebe abu adeola ahmad ahmed ajay akash akira al alhassan ali amadou amir amit anand anil arjun arun aryan ashok aziz babak bahram berk bilal burak cem chang chen chidi chinedu chukwu daichi daiki dawit deepak dinesh ehsan emeka emre eyal faisal farhad farid feng femi ganesh gopal hadi hakan hamid hamza hao haruto hasan hassan hiro hiroshi hossein hyun ibrahim "
    "imran ismail jabari jamal javed jian jie jihoon jin joon juma jun kamal karim karthik kazuki kenji khaled khalid kiran kofi kojo kumar kunal kwame kwesi lei levent long mahmoud malik manish mansour masato mehdi mehmet ming minh mohamed mohammad mohammed mohan mohsen moshe murat musa mustafa naveed naveen nikhil niko obinna okoro omid osman pradeep prakash qasim quang rahim rahul raj rajesh "
    "rakesh ramesh rashid ravi reza rohan rohit saeed sajid salim samir sanjay satoshi selim shahid shahram shan shigeru siddharth sunil suresh syed takashi takumi tao tariq taro tarek tendai tuan tunde umar uri usman vijay vikram vinod vikas wale waleed wei xiang yakov yaw yosef yusuf yuto zahid zaid zeeshan zhang"
).split()
FEMALE = frozenset([*FEMALE_EUROPE, *FEMALE_EUROPE_2, *FEMALE_EUROPE_3, *FEMALE_WORLD])
MALE = frozenset([*MALE_EUROPE, *MALE_EUROPE_2, *MALE_EUROPE_3, *MALE_WORLD])
#: Given names that are also words, places or makers: alone they count only beside a cue.
AMBIGUOUS = frozenset(
    "amber angel angelo april art august aurora austin axel basil bel bell ben bill bob brad brandon brett bruce carol chang chase chelsea chen chuck cindy clement constance craig dale dalia dan daisy dana dawn dean devi dick dina dora ed faith fay florence flora frank gail gemma georgia gilles glen gloria grace grant guy hal hao hazel heather helm holly "
    "hope hugo ida iris ivy jack jan jasmine java jean jed jerry jia jim jin jo job jordan joy june jun juno kai kim kit lan lance lata lee lei len leo ling lily linda long louis lucky luna mai mark max may maya mei mercedes mia mick milan mina ming min mona morgan nana nat norma nova noor ole opal orlando paris pat pat patience pearl penny percy perry phoenix pilar ray red reed rich rick rita rob robin "
    "rod rose ross roy ruby rudy ruth sally sam sandy santiago sasha sean serge shan shane shannon sierra sidney sky sol sora spring stan stella stone sue summer sunny sydney tam tao terry tim tina tom tony tori tracy tristan troy ula uri valentine vera victor victoria viola violet virginia wade wale wei wes will willow xiang"
    .split()
)
