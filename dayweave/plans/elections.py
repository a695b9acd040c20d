"""The 24 election panels: 12 elections x candidates or parties, as data."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# Code and name of each election, in order.
ELECTIONS = """
CR10 Costa Rica 2010
CR14 Costa Rica 2014
CR18 Costa Rica 2018
CR22 Costa Rica 2022
ES14 El Salvador 2014
ES19 El Salvador 2019
GU11 Guatemala 2011
GU15 Guatemala 2015
GU19 Guatemala 2019
HO13 Honduras 2013
HO17 Honduras 2017
HO21 Honduras 2021
"""

# First and last day kept in each panel; c = candidates, p = parties.
WINDOWS = """
CR10_c 2009-10-25 2010-02-02
CR10_p 2009-10-03 2010-02-04
CR14_c 2013-11-06 2014-02-03
CR14_p 2013-10-18 2014-03-26
CR18_c 2017-11-10 2018-02-02
CR18_p 2017-10-11 2018-02-13
CR22_c 2021-11-11 2022-01-10
CR22_p 2021-10-11 2022-02-01
ES14_c 2013-09-23 2014-03-09
ES14_p 2013-09-23 2014-03-09
ES19_c 2018-10-03 2019-02-03
ES19_p 2018-10-02 2019-02-03
GU11_c 2011-05-08 2011-09-03
GU11_p 2011-05-03 2011-09-26
GU15_c 2015-05-22 2015-09-02
GU15_p 2015-05-05 2015-09-04
GU19_c 2019-01-18 2019-08-07
GU19_p 2019-02-19 2019-06-15
HO13_c 2013-05-23 2013-11-24
HO13_p 2013-05-24 2013-11-24
HO17_c 2017-05-25 2017-11-25
HO17_p 2017-05-25 2017-11-14
HO21_c 2021-05-27 2021-11-21
HO21_p 2021-06-22 2021-09-10
"""

# Account dropped before anything else is computed.
DROPPED_FIRST = """
CR10_c Luis Fishman
"""

# Single accounts dropped from the daily table.
DROPPED = """
CR10_c Eugenio Trejos
CR14_p Renovación PRC
CR18_p Renovación PRC
ES14_p PSP
GU11_c Manuel Antonio Baldizón MAN
GU19_p GUATEMALA PODEMOS
HO13_c Orle Solís
HO13_p PINU-SD HONDURAS
HO17_c Marlene Alvarenga
"""

# Lists of accounts whose filter keeps rows that differ from any of them.
DROPPED_IF_ALL = """
CR22_c Dr Walter Muñoz.
CR22_c Dr. Christian Rivera
CR22_c Rodrigo Chaves
CR22_c Sergio Mena Díaz
CR22_p Partido Fuerza Nacional
CR22_p Progreso Social Democrático
CR22_p Pueblo Unido CR
CR22_p Unidos Podemos Costa Rica
GU11_p CREO GUATEMALA
GU11_p PANResponde
HO17_p Alianza Patriótica Hondureña
HO17_p Diputados PAC
HO21_p Alianza Patriótica Hondureña
HO21_p LIDEHR
HO21_p Partido Nueva Ruta de Honduras (PNRH)
"""

# Handle left out of the Analytic curves, where handles are in the input.
DROPPED_HANDLES = """
CR14_c jmechandi
"""

# Panel, column alias and account of the wide tables, in column order.
WIDE = """
ES14_c NormanQuijano Norman Quijano
ES14_c SalvadorSanchez Salvador Sánchez Cerén
ES14_c TonySaca Tony Saca
ES14_p ARENA ARENA
ES14_p FMLN FMLN
ES14_p FMLNOficial FMLN Oficial
ES14_p PARTIDOGANA PARTIDO GANA
ES14_p PCN PCN
ES19_c CarlosCalleja Carlos Calleja
ES19_c HugoMartinez Hugo Martínez
ES19_c JosueAlvarado Josué Alvarado
ES19_c NayibBukele Nayib Bukele
ES19_p ARENA ARENA
ES19_p DemocraciaSalvadorena Democracia Salvadoreña
ES19_p FMLN FMLN
ES19_p FMLNOficial FMLN Oficial
ES19_p PARTIDOGANA PARTIDO GANA
ES19_p PCN PCN
ES19_p VAMOS VAMOS
HO13_c JOH Juan Orlando H.
HO13_c MauricioVilleda Mauricio Villeda Bermúdez
HO13_c XiomaraCastro Xiomara Castro de Zelaya
HO13_p PartidoLiberal Partido Liberal de Honduras
HO13_p PartidoLibre Partido Libre
HO17_c LuisZelaya Luis Zelaya
HO17_c SalvadorNasralla Salvador Nasralla
HO17_c JOH Juan Orlando H.
HO17_p PartidoLibre Partido Libre
HO17_p PartidoNacional Partido Nacional
HO17_p PINUSD PINU-SD HONDURAS
HO21_c EsdrasAmadoLopez Esdras Amado Lopez
HO21_c MarlonEscotoTSH Marlon Escoto TSH
HO21_c MarlonEscotoValerio Marlon Escoto Valerio
HO21_c MiltonBenítez Milton Benítez
HO21_c SalvadorNasralla Salvador Nasralla
HO21_c XiomaraCastrodeZelaya Xiomara Castro de Zelaya
HO21_c YaniRosenthal Yani Rosenthal
HO21_p PartidoLiberal Partido Liberal de Honduras
HO21_p PartidoLibre Partido Libre
HO21_p PartidoSalvador Partido Salvador de Honduras
"""


def _rows(table: str, columns: int) -> list[list[str]]:
    """Split each line at its first spaces; the last column may contain spaces."""
    return [line.split(" ", columns - 1) for line in table.strip().splitlines()]


@dataclass(frozen=True)
class Elections:
    """The tables above with the panel keys as they occur in the data.

    The texts that mark candidates and parties in `type_of_account` come from the data.
    """

    candidate: str
    party: str

    def keys(self, panel: str) -> tuple[str, str]:
        election, kind = panel.split("_")
        return dict(_rows(ELECTIONS, 2))[election], {"c": self.candidate, "p": self.party}[kind]

    def _named(self, table: str) -> list[tuple]:
        return [(*self.keys(panel), name) for panel, name in _rows(table, 2)]

    @property
    def codes(self) -> list[tuple]:
        """(election, account type, panel code), 24 of them."""
        return [(*self.keys(panel), panel) for panel, _ in _rows(WINDOWS, 2)]

    @property
    def windows(self) -> list[tuple]:
        return [
            (*self.keys(panel), date.fromisoformat(lo), date.fromisoformat(hi))
            for panel, lo, hi in _rows(WINDOWS, 3)
        ]

    @property
    def dropped_first(self) -> list[tuple]:
        return self._named(DROPPED_FIRST)

    @property
    def dropped(self) -> list[tuple]:
        return self._named(DROPPED)

    @property
    def dropped_if_all(self) -> list[tuple]:
        return self._named(DROPPED_IF_ALL)

    @property
    def dropped_handles(self) -> list[tuple]:
        return self._named(DROPPED_HANDLES)

    @property
    def wide(self) -> list[tuple]:
        """(election, account type, account, alias), in column order."""
        return [(*self.keys(panel), account, alias) for panel, alias, account in _rows(WIDE, 3)]
